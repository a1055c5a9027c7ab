"""Operator 13: alignment of two tokenizers' tokens on the bytes of each text.

Tokenizer A is a byte-level BPE file of ``tokenizers``, B a ``sentencepiece`` BPE model with byte
fallback.  A encodes a space and the text, B the text, before which it puts a space itself, so both
cover the same bytes.  Strings of special tokens are plain text for both.

1. Stretches.  A single space between two characters that are no white space starts a new token in
   both: A's word pattern lets a space only lead a word, and no piece of B has a space after
   anything else.  Texts of more than ``STRETCH`` characters are cut there, so a very long text
   never meets a tokenizer at once.  Both is checked when the tokenizers are loaded; if it doesn't
   hold, or a text has no such space, the whole text is one stretch.
2. Divide and conquer.  In a stretch, an end that both tokenizations share is looked for from the
   middle of A's ends outwards, by bisection in B's; both halves are worked on alike.  An interval
   without a shared end inside is a group.  All stretches of a block go down together, one level
   of intervals at a time, so a level is a few passes over arrays.
3. Links.  Every end of either side, but for shared ones once, ends the overlap of one pair of
   tokens: these pairs are the links.  One pass writes them with the sizes and digests of each text
   as a Parquet table, beside how often each task met each pair; Spark adds these up.
4. Score.  The pairs counted most, at most ``MOST`` of them, go to the tasks with their counts,
   and each text sums its links.  Links of other pairs, if any, meet their counts in a join.

A text that is null, empty, or that A or B changes (joined token bytes other than the space and the
text) has no tokens: all numbers 0 and groups_sha256 ''; its links count nowhere.  Rows come back
one for one, repeated ones too, null doc_ids included.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, compress, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from .bpe import byte_symbols
from .common import cut, join_hot, read

#: Characters of a stretch, and of a block that is worked on together; pairs that are sent to all tasks, and that a task holds.
STRETCH, BLOCK_CHARS, MOST, HELD = 1 << 16, 1 << 19, 1_000_000, 2_000_000
_BLANK, _SPACE = "\u2581", re.compile(r"(?<=\S) (?=\S)")
# Fixed value: the word pattern of byte-level BPE.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TABLE = "kind int, doc_id string, n_a long, n_b long, n_groups long, groups_sha256 string, a binary, b binary, pair long, n long"
_ALIGNED = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<pair:long,n:long>>"


def shared_ends(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Indexes of all ends that a[i:j] and b[k:l] share, for many intervals at once; a and b rise."""
    found = [np.empty((2, 0), np.int64)]
    # every end of a is looked up once, in order; the search from the middle reads the answers
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = b[at] == a
    while True:
        some = (i < j) & (k < l)
        i, j, k, l = i[some], j[some], k[some], l[some]  # noqa: E741
        if not len(i):
            p, q = np.concatenate(found, axis=1)
            return np.sort(p), np.sort(q)
        middle, p = (i + j) // 2, np.full(len(i), -1)
        open_, step = np.arange(len(i)), 0
        while len(open_):
            for side in (middle + step, middle - step - 1):
                here = side[open_]
                inside = (here >= i[open_]) & (here < j[open_])
                hit = inside & shared[here * inside]
                p[open_[hit]] = here[hit]
                open_ = open_[~hit]
            step += 1
            open_ = open_[(middle + step < j)[open_] | (middle - step - 1 >= i)[open_]]
        cut_ = p >= 0
        i, j, k, l, p = i[cut_], j[cut_], k[cut_], l[cut_], p[cut_]  # noqa: E741
        q = at[p]
        found.append(np.stack([p, q]))
        i, j, k, l = np.append(i, p + 1), np.append(p, j), np.append(k, q + 1), np.append(q, l)  # noqa: E741


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(a)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.a, self.b = Tokenizer.from_str(a.decode("utf-8")), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        value = {c: bytes([i]) for i, c in enumerate(byte_symbols())}
        names = {**vocab, **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = b"".join(value.get(c, c.encode("utf-8")) for c in name)
        pieces = ["" if self.b.is_byte(i) else self.b.id_to_piece(i).replace(_BLANK, " ") for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else p.encode("utf-8") for i, p in enumerate(pieces)]
        words = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
        sample = "A\u0130  \xe9\uff21 "
        as_is = b"".join(self.b_bytes[i] for i in self.b.encode(sample)).decode("utf-8", "replace") == " " + sample
        self.apart = plain and as_is and not any(" " in p.lstrip(" ") for p in pieces)
        # where merges have the order of their ids, the faster library gives the same ids
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        self.fast = None
        if plain and made == sorted(set(made)):
            special = {t["content"] for t in spec["added_tokens"]}
            self.fast = tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks={self.a_bytes[i]: i for name, i in vocab.items() if name not in special}, special_tokens={}).encode_ordinary
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        # a token as text, followed by a comma, a bar, a semicolon or nothing
        top = max(len(self.a_bytes), len(self.b_bytes))
        self.named = [f"{i}{end}" for end in (",", "|", ";", "") for i in range(top)]
        self.top = top

    def stretches(self, text: str) -> list[str]:
        """Parts of a text; between two of them is a space that starts a token of both."""
        out, low = [], 0
        while self.apart and len(text) - low > STRETCH:
            cut_ = _SPACE.search(text, low + STRETCH - 1)
            if cut_ is None:
                break
            out.append(text[low : cut_.start()])
            low = cut_.end()
        return [*out, text[low:]]

    def a_ids(self, part: str) -> list[int]:
        """A's ids of a space and the part; newer letters may be unknown to one library's tables, so only Latin goes the fast way."""
        if self.fast is None:
            return self.a.encode(" " + part, add_special_tokens=False).ids
        if part.isascii() or max(part) < "\u0250":
            return self.fast(" " + part)
        ids = []
        for latin, run in groupby(_SPACE.split(part), lambda p: p.isascii() or max(p) < "\u0250"):
            run = " " + " ".join(run)
            ids += self.fast(run) if latin else self.a.encode(run, add_special_tokens=False).ids
        return ids

    def align(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """``n_a, n_b, n_groups, n_links`` of each part (-1, -1, -1, 0 if bytes differ), the links of all (A's id above 32 bits of B's), groups as text."""
        sizes, texts = np.full((len(parts), 4), [-1, -1, -1, 0]), [""] * len(parts)
        own = [b" " + p.encode("utf-8", "surrogatepass") for p in parts]
        x, y = [self.a_ids(p) for p in parts], self.b.encode(parts, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
        x, y = (np.fromiter(chain.from_iterable(z), np.int64, n.sum()) for z, n in ((x, n_a), (y, n_b)))
        length = np.fromiter(map(len, own), np.int64, len(own))
        same = np.ones(len(parts), bool)
        for ids, n, size in ((x, n_a, self.a_size), (y, n_b, self.b_size)):
            same &= np.bincount(np.repeat(np.arange(len(n)), n), size[ids], len(n)) == length
        for ids, n, value in ((x, n_a, self.a_bytes), (y, n_b, self.b_bytes)):
            # equal lengths each, so all parts are equal if their joined bytes are
            if b"".join(map(value.__getitem__, ids[np.repeat(same, n)].tolist())) != b"".join(compress(own, same)):
                for i, u, v in zip(range(len(n)), np.cumsum(n) - n, np.cumsum(n)):
                    same[i] = same[i] and b"".join(map(value.__getitem__, ids[u:v].tolist())) == own[i]
        held = np.flatnonzero(same)
        x, y, n_a, n_b = x[np.repeat(same, n_a)], y[np.repeat(same, n_b)], n_a[held], n_b[held]
        if not len(held):
            return sizes, np.empty(0, np.int64), texts
        a, b = np.cumsum(self.a_size[x]), np.cumsum(self.b_size[y])
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        p, q = shared_ends(a, b, end_a - n_a, end_a - 1, end_b - n_b, end_b - 1)
        p, q = np.sort(np.append(p, end_a - 1)), np.sort(np.append(q, end_b - 1))
        # groups, and their tokens as text
        of = np.searchsorted(end_a, p, "right")
        size_a, size_b = np.diff(p, prepend=-1), np.diff(q, prepend=-1)
        total = size_a + size_b
        begin = np.cumsum(total) - total
        code = np.empty(total.sum(), np.int64)
        code[np.arange(len(x)) + np.repeat(begin - (np.cumsum(size_a) - size_a), size_a)] = x
        code[np.arange(len(y)) + np.repeat(begin + size_a - (np.cumsum(size_b) - size_b), size_b)] = y
        code[begin + size_a - 1] += self.top
        code[begin + total - 1] += self.top * np.where(np.append(of[1:] != of[:-1], True), 3, 2)
        named = list(map(self.named.__getitem__, code.tolist()))
        stops = np.cumsum(np.bincount(of, total, len(held)).astype(np.int64)).tolist()
        for i, u, v in zip(held.tolist(), [0, *stops], stops):
            texts[i] = "".join(named[u:v])
        # the ends of A and those of B's that aren't shared, in order; a link's tokens are the first to end there or later
        lone, shared = np.ones(len(b), bool), np.zeros(len(a), np.int64)
        lone[q], shared[p] = False, 1
        order = np.argsort(np.concatenate([a, b[lone]]), kind="stable")
        of_a = order < len(a)
        before_a = np.cumsum(of_a) - of_a
        links = x[before_a] << 32 | y[np.arange(len(order)) - before_a + (np.cumsum(shared) - shared)[np.minimum(before_a, len(a) - 1)]]
        n_groups = np.bincount(of, minlength=len(held))
        sizes[held] = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups], 1)  # a group has one link less than tokens
        return sizes, links, texts


class PairCounts:
    """Links by pair, of a task."""

    def __init__(self):
        self.pair, self.n = [], []
        self.size = 0

    def add(self, pairs: np.ndarray) -> None:
        pair, n = np.unique(pairs, return_counts=True)
        self.pair.append(pair)
        self.n.append(n)
        self.size += len(pair)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        pair, at = np.unique(np.concatenate([np.empty(0, np.int64), *self.pair]), return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, np.concatenate([np.empty(0, np.int64), *self.n]))
        self.pair, self.n, self.size = [pair], [n], len(pair)

    def rows(self) -> pd.DataFrame:
        self.merge()
        out = pd.DataFrame({"kind": 1, "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "groups_sha256": None, "a": None, "b": None, "pair": self.pair[0], "n": self.n[0]})
        self.__init__()
        return out


_LOADED: dict[bytes, Aligner] = {}


def _aligner(files) -> Aligner:
    """The worker's aligner of a broadcast (digest, file of A, file of B)."""
    digest, a, b = files.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Aligner(a, b)
    return _LOADED[digest]


def _parts(pdf: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    """``ids, texts`` of consecutive rows of about BLOCK_CHARS characters."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array):
        text = text if isinstance(text, str) else ""
        if texts and size + len(text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
    if texts:
        yield ids, texts


def _aligned(files):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, counts = _aligner(files), PairCounts()
        narrow = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (aligner.a_bytes, aligner.b_bytes)]
        for pdf in batches:
            for ids, texts in _parts(pdf):
                parts = [aligner.stretches(t) if t else [] for t in texts]
                first = np.cumsum([0, *map(len, parts)]).tolist()
                sizes, links, named = aligner.align([p for own in parts for p in own])
                at = np.cumsum(np.append(0, sizes[:, 3])).tolist()
                out, told = [], []
                for doc_id, i, j in zip(ids, first, first[1:]):
                    if i == j or (sizes[i:j, 0] < 0).any():
                        out.append((0, doc_id, 0, 0, 0, "", b"", b"", 0, 0))
                        continue
                    pairs = links[at[i] : at[j]]
                    told.append(pairs)
                    digest = hashlib.sha256(";".join(named[i:j]).encode()).hexdigest()
                    out.append((0, doc_id, *sizes[i:j, :3].sum(axis=0).tolist(), digest, (pairs >> 32).astype(narrow[0]).tobytes(), (pairs & 0xFFFFFFFF).astype(narrow[1]).tobytes(), 0, 0))
                if told:
                    counts.add(np.concatenate(told))
                if counts.size > HELD:  # still, after a merge: so many different pairs
                    yield counts.rows()
                yield pd.DataFrame(out, columns=["kind", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b", "pair", "n"])
        yield counts.rows()

    return run


def _scored(counts):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, n, best = counts.value
        for pdf in batches:
            out = []
            for doc_id, n_a, n_b, n_groups, digest, x, y in zip(*(pdf[c].array for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b"))):
                n_links = n_a + n_b - n_groups  # a group has one link less than tokens
                if not n_links:
                    out.append((doc_id, 0, 0, 0, 0, 0, 0, digest, []))
                    continue
                x, y = (np.frombuffer(z, f"<u{len(z) // n_links}").astype(np.int64) for z in (x, y))
                own = x << 32 | y
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                held = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                rare, many = np.unique(own[~held], return_counts=True)
                at = at[held]
                rest = [{"pair": q, "n": m} for q, m in zip(rare.tolist(), many.tolist())]
                out.append((doc_id, n_a, n_b, n_groups, n_links, int(best[at].sum()), int(n[at].sum()), digest, rest))
            yield pd.DataFrame(out, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "rest"])

    return run


def _best(parts: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids in all texts, and whether no pair of the B id has more."""
    counts = cut(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut(counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame, most: int) -> tuple[int, list[np.ndarray]]:
    """A least count that at most ``most`` pairs reach, and those pairs in order, with count and best."""
    size = F.floor(F.log2("n")).cast("int")
    low, held = 0, 0
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # at most 63 rows
        held += row["count"]
        if held > most:
            low = 1 << (row["size"] + 1)
            break
    table = counts.filter(F.col("n") >= low).toArrow()
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return low, [pair[order], n[order], best[order].astype(np.int64)]


def align(documents: DataFrame, a: str, b: str, most: int = MOST) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` and ``b`` are paths of the tokenizers on the driver, which sends their content to the tasks.
    """
    sc = documents.sparkSession.sparkContext
    content = []
    for path in (a, b):
        with open(path, "rb") as f:
            content.append(f.read())
    files = sc.broadcast((hashlib.sha256(b"".join(content)).digest(), *content))
    docs, path = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), scratch(documents.sparkSession)
    docs.mapInPandas(_aligned(files), _TABLE).write.partitionBy("kind").parquet(path)
    table = documents.sparkSession.read.schema(_TABLE).parquet(path)
    counts = _best(table.filter("kind = 1").select("pair", "n"))
    low, frequent = _frequent(counts, most)
    aligned = table.filter("kind = 0").select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "a", "b")
    rows = aligned.mapInPandas(_scored(sc.broadcast(frequent)), _ALIGNED)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    if low == 0:
        return rows.drop("rest")
    # the digest names the tokens of a text, so equal texts meet their rare pairs once
    rows = cut(rows)
    rare = rows.filter(F.size("rest") > 0)
    texts = rare.groupBy("groups_sha256").agg(F.count("*").alias("n_rows"))
    one = rare.select("groups_sha256", "rest").dropDuplicates(["groups_sha256"]).select("groups_sha256", F.explode("rest").alias("r"))
    met = one.select("groups_sha256", "r.pair", F.col("r.n").alias("times")).join(counts, "pair")
    more = met.groupBy("groups_sha256").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    told = join_hot(rare.drop("rest"), more.join(texts, "groups_sha256"), ["groups_sha256"], "n_rows", "doc_id")
    told = told.withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more_sum"))
    return told.drop("more_best", "more_sum", "n_rows").unionByName(rows.filter(F.size("rest") == 0).drop("rest"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
