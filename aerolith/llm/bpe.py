"""Operator 9: byte-pair encoding and decoding with a contiguous rank array.

The vocabulary is a ``tokenizers`` JSON file with byte-level symbols and word ends;
its path is a parameter.  A word's parts and the ranks of adjacent pairs lie in two
short arrays: scan for the smallest rank, write the merged part, delete the boundary
by moving the tail up, refresh the two neighbouring ranks, until no rank is left.
The new words of a block are worked on together, one array row a word.

A word of more than 100 bytes keeps its candidate ranks in a heap instead, since an
array scan would be quadratic in its length; the merges are the same, in the same order.

Words repeat, so a worker keeps the last words it has seen, up to ``CACHE`` of them.
Null text is empty and has no tokens; a null doc_id stays null, and every row comes back,
repeated ones too.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

CACHE, BLOCK_CHARS = 250_000, 1 << 20
#: White space of Unicode, as a regex class.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([a * self.size + b for a, b, _ in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.merged = np.array([m for _, _, m in pairs], np.int32)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (b >= 0), self.rank[at], _NONE)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, 36), (36, 100)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(some), 1 << 14):
                self._merge_rows(words, some[i : i + (1 << 14)], sizes, high, out)
        for i in np.flatnonzero(sizes > 100):
            out[i] = self._merge_long(words[i])
        return out

    def _merge_rows(self, words: list[bytes], rows: np.ndarray, sizes: np.ndarray, width: int, out: list[bytes]) -> None:
        if not len(rows):
            return
        n = sizes[rows]
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
        column = np.arange(width)
        parts = np.where(column < n[:, None] - 1, self.inner[raw], self.final[raw])
        parts[column >= n[:, None]] = -1
        ranks = np.full(parts.shape, _NONE, np.int32)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        live = np.arange(len(rows))
        done = np.empty_like(parts)
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            least = ranks[row, at]
            more = least != _NONE
            if not more.all():
                done[live[~more]] = parts[~more]
                live, parts, ranks, at, least = live[more], parts[more], ranks[more], at[more], least[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            tail = np.minimum(column + (column > at[:, None]), width - 1)
            parts[row, at] = self.merged[least]
            parts = np.take_along_axis(parts, tail, 1)
            parts[:, -1] = np.where(at < width - 1, -1, parts[:, -1])
            # rank i belongs to the pair (i, i + 1): the one after the deleted boundary moves up too
            ranks = np.take_along_axis(ranks, tail, 1)
            ranks[:, -1] = _NONE
            after = np.minimum(at + 1, width - 1)
            ranks[row, at] = np.where(at + 1 < width, self.ranks(parts[row, at], parts[row, after]), _NONE)
            before = np.maximum(at - 1, 0)
            ranks[row, before] = np.where(at > 0, self.ranks(parts[row, before], parts[row, at]), ranks[row, before])
        length = (done >= 0).sum(axis=1)
        for i, ids, k in zip(rows, done, length):
            out[i] = ids[:k].astype("<u4").tobytes()

    def _merge_long(self, word: bytes) -> bytes:
        """The same for a word of any length: only pairs next to a merge change, so ranks wait in a heap."""
        import heapq

        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw]
        parts[-1] = self.final[raw[-1]]
        parts = parts.tolist()
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        index = self.pair_index
        heap = [(r, i) for i in range(len(parts) - 1) if (r := index.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= len(parts) or index.get((parts[i], parts[j])) != r:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (q := index.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (q, x))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    @property
    def pair_index(self) -> dict[tuple[int, int], int]:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k) // self.size, int(k) % self.size): int(r) for k, r in zip(self.key, self.rank)}
        return self._pairs

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        runs: list[list[list[str] | int]] = []
        for text in texts:
            if self.split is not None and self.split.search(text):
                run, at = [], 0
                for m in self.split.finditer(text):
                    run += [self.pieces(text[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                runs.append([*run, self.pieces(text[at:])])
            else:
                runs.append([self.pieces(text)])
        self._learn({w for run in runs for part in run if not isinstance(part, int) for w in part})
        find = self.known.__getitem__
        return [b"".join(part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(find, part)) for part in run) for run in runs]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHE:
            self.known, self.older = {}, self.known
        new = []
        for w in words - self.known.keys():
            held = self.older.get(w)
            if held is None:
                new.append(w)
            else:
                self.known[w] = held
        self.known.update(zip(new, self.merge_words([w.encode("utf-8", "surrogatepass") for w in new])))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _coded(path: str, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for pdf in batches:
            texts, low, size = [], 0, 0
            for i, text in enumerate([*pdf["text"].array, None]):
                end = i == len(pdf)
                if texts and (end or size > BLOCK_CHARS):
                    ids = bpe.encode(texts)
                    out = {"doc_id": pdf["doc_id"].array[low:i], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
                    yield pd.DataFrame(out | ({"decoded": [bpe.decode(x) for x in ids]} if with_text else {}))
                    texts, low, size = [], i, 0
                if not end:
                    texts.append(text if isinstance(text, str) else "")
                    size += len(texts[-1])

    return run


def _with_ids(documents: DataFrame, coded, columns: str) -> DataFrame:
    # ids go through pandas as text: beside a null, longs would turn into doubles
    out = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(coded, f"doc_id string, {columns}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    return _with_ids(documents, _coded(vocabulary, False), "n_tokens long, ids binary")


def encode_decode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``encode`` with ``decoded``, the text that the ids decode to, special tokens included."""
    return _with_ids(documents, _coded(vocabulary, True), "n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded`` with ``decoded`` from its ``ids``; null ids give null."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = load(vocabulary)
        return pd.Series([None if x is None else bpe.decode(x) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text("ids"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
