"""Operator 12: removal of repeated passages by suffix automata of reference shards.

A window is ``width`` consecutive words of one document.  Every word goes that lies in a window
whose words also stand in a document with a smaller doc_id.  Every document is a reference for all
later ones, so the reference grows with the corpus: its shards are dealt to the tasks by content
and documents are streamed to the shards that can hold their passages, instead of sending each shard
to all tasks.

1. Pick.  Of each window the smallest hash of ``GRAM`` words (the first of equal ones) is picked.
   Equal windows pick alike.  The words of all windows that pick one place are a passage, known by
   the picked hash, its fingerprint, and a hash of its words.
2. Meet.  Passages are shuffled by fingerprint, as hashes and places only.  Of equal passages all
   but those of the smallest document are repeated.  Where a fingerprint has different
   passages, they may share windows: they go on.  What repeats inside a task is settled there, so a
   passage in a third of all documents sends about one row a task.
3. Shards.  Passages that go on are cut out of their texts.  Those of some fingerprints, about
   ``SHARD`` words, make a reference shard: its suffix automaton knows the smallest document of
   each substring.  They are streamed through it for matching statistics, and where a match of
   ``width`` words or more has a smaller document, its last ``width`` words are repeated.
4. Remove.  Repeated spans of a document are merged, and its other words stay, joined by spaces.

A phrase that many documents go on differently would bring all of them to one fingerprint.  A first
pass finds fingerprints that have more than ``MANY`` passages inside some task; their windows are dealt
by their whole content, so no shard holds more than MANY passages a task of one fingerprint.
Hashes have 128 bits together.

A word is a run of characters other than space and U+0009 to U+000D.  Null text has no words and
stays null; a null doc_id takes no part.  Rows that share doc_id and text are one document; of rows that
share only the doc_id none is smaller, so they take nothing from each other.  A text that loses
all words is empty, its row stays.  A text is laid out in parts of PIECE bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from .common import BLOCK_BYTES, Seen, fresh, mix, read, signed, text_keys

#: Words of a window, and of the picked part of it.
WIDTH, GRAM = 13, 7
#: Words of a reference shard, bytes of text that are laid out at once.
SHARD, PIECE = 1 << 15, 4 << 20
#: Passages of one fingerprint in a task from which its windows are dealt alone; such fingerprints that are sent to the tasks.
MANY, MOST_HOT = 16, 1_000_000

_MIX = np.random.default_rng(1312).integers(0, 2**63, (3, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_PLACE = "fp long, c long, doc long, nth int, first int, last int, known boolean"
_MET = "kind int, fp long, doc long, nth int, first int, last int"
_SPAN = "doc long, first int, last int"


def pieces(text: bytes, keep: int) -> Iterator[tuple[int, bytes]]:
    """``first, piece``: parts of a text of about PIECE bytes, and the place of their first word; a part starts with the last ``keep`` words of the one before."""
    low = first = 0
    reach = PIECE
    while len(text) - low > reach:
        end = _BLANK.search(text, low + reach)
        if end is None:
            break
        part = text[low : end.start()]
        n = len(part.split())
        if n <= keep:  # very long words
            reach *= 2
            continue
        yield first, part
        first, low, reach = first + n - keep, low + len(part.rsplit(None, keep)[0]), PIECE
    yield first, text[low:]


def _run_hash(word: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words from ``first`` on."""
    out = size.astype(np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        some = size > k
        out[some] += word[first[some] + k] * _MIX[seed, k % 256]
    return mix(out)


def passages_of(texts: list[bytes], width: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """``text, first, last, fp, c`` of the passages of all texts, in order; windows of hot fingerprints are passages of their own."""
    words = [t.split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, count.sum())
    n = len(word) - width + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 5
    of = np.repeat(np.arange(len(texts)), count)
    begin = np.cumsum(count) - count
    hashes = _run_hash(word, np.arange(len(word) - gram + 1), np.full(len(word) - gram + 1, gram), 0)
    low, place = hashes[:n].copy(), np.arange(n)
    for k in range(1, width - gram + 1):
        less = hashes[k : k + n] < low
        low[less] = hashes[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    window = np.flatnonzero(of[:n] == of[width - 1 :])
    fp, place = signed(low[window]), place[window]
    apart = np.isin(fp, hot) if len(hot) else np.zeros(len(fp), bool)
    # windows that pick one place are neighbours
    new = np.append(True, (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1) | apart[1:])[: len(window)]
    first, last = window[new], window[np.append(np.flatnonzero(new)[1:] - 1, len(window) - 1)] + width if len(window) else window
    fp, apart = fp[new], apart[new]
    fp[apart] = signed(_run_hash(word, first[apart], np.full(apart.sum(), width), 1))
    c = signed(_run_hash(word, first, last - first, 2))
    return of[first], first - begin[of[first]], last - begin[of[first]], fp, c


def _texts(pdf: pd.DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Blocks of about BLOCK_BYTES: row of the frame, place of the first word, and bytes of whole texts or parts of them."""
    rows, places, texts, size = [], [], [], 0
    for row, text in enumerate(pdf["bytes"].array):
        for first, part in pieces(text, width - 1):
            if texts and size + len(part) > BLOCK_BYTES:
                yield np.array(rows), np.array(places), texts
                rows, places, texts, size = [], [], [], 0
            rows.append(row)
            places.append(first)
            texts.append(part)
            size += len(part)
    if texts:
        yield np.array(rows), np.array(places), texts


def _hot(width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fingerprints with more than MANY different passages in the task."""
        held: list[np.ndarray] = []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            rows = np.unique(np.concatenate([np.empty((0, 2), np.int64), *held]), axis=0)
            held[:] = [rows]
            return np.unique(rows[:, 0], return_counts=True)

        for pdf in batches:
            for _, _, texts in _texts(pdf, width):
                _, _, _, fp, c = passages_of(texts, width, gram, np.empty(0, np.int64))
                order = np.lexsort((c, fp))
                fp, c = fp[order], c[order]
                # of a block, fingerprints with several passages
                several = np.zeros(len(fp), bool)
                differs = (fp[1:] == fp[:-1]) & (c[1:] != c[:-1])
                several[1:] |= differs
                several[:-1] |= differs
                held.append(np.stack([fp[several], c[several]], 1))
                if sum(map(len, held)) > 1 << 20:
                    fp, n = counted()
                    yield pd.DataFrame({"fp": fp[n > MANY], "n": n[n > MANY]})
                    held.clear()
        fp, n = counted()
        yield pd.DataFrame({"fp": fp[n > MANY], "n": n[n > MANY]})

    return run


def hot_fingerprints(docs: DataFrame, width: int, gram: int) -> np.ndarray:
    """The fingerprints that are most often found to be hot, at most MOST_HOT; results don't depend on them."""
    found = docs.select("bytes").mapInPandas(_hot(width, gram), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
    return np.sort(found.orderBy(F.col("n").desc(), "fp").limit(MOST_HOT).select("fp").toArrow().column("fp").to_numpy())


def _places(width: int, gram: int, hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            doc, nth = pdf["doc"].to_numpy(np.int64), pdf["nth"].to_numpy(np.int64)
            for row, base, texts in _texts(pdf, width):
                of, first, last, fp, c = passages_of(texts, width, gram, hot.value)
                row, base = row[of], base[of]
                known = seen.later([doc[row] - nth[row]], fp, c)
                yield pd.DataFrame({"fp": fp, "c": c, "doc": doc[row], "nth": nth[row], "first": base + first, "last": base + last, "known": known})

    return run


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeated spans (kind 0), and passages that may share windows with others (kind 1); open rows come by fingerprint, passage and document."""
    rest = None

    def rows(kind: int, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["fp", "doc", "nth", "first", "last"]].assign(kind=kind)[["kind", "fp", "doc", "nth", "first", "last"]]

    def contested(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, c = pdf["fp"].to_numpy(), pdf["c"].to_numpy()
        start = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])[: len(fp)])
        size = np.diff(np.append(start, len(fp)))
        return rows(1, pdf[np.repeat(c[start] != c[start + size - 1], size)])

    for pdf in batches:
        known = pdf["known"].to_numpy(bool)
        if known.any():
            yield rows(0, pdf[known])
            pdf = pdf[~known]
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        fp, c, low = pdf["fp"].to_numpy(), pdf["c"].to_numpy(), (pdf["doc"] - pdf["nth"]).to_numpy()
        start = np.flatnonzero(np.append(True, (fp[1:] != fp[:-1]) | (c[1:] != c[:-1])))
        later = low != np.repeat(low[start], np.diff(np.append(start, len(fp))))
        yield rows(0, pdf[later])
        # the last fingerprint may go on in the next batch
        tail = fp == fp[-1]
        yield contested(pdf[~later & ~tail])
        rest = pdf[~later & tail]
    if rest is not None:
        yield contested(rest)


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the passages of each text."""
    columns = ["fp", "doc", "nth", "first", "words"]
    for pdf in batches:
        out: list[tuple] = []
        for doc, nth, raw, own in zip(pdf["doc"].tolist(), pdf["nth"].tolist(), pdf["bytes"].array, pdf["own"].array):
            words, marks = raw.split(), own.tolist()
            out += [(fp, doc, nth, i, b" ".join(words[i:j])) for fp, i, j in zip(marks[::3], marks[1::3], marks[2::3])]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)


class Automaton:
    """Suffix automaton of a shard's passages; each state knows the smallest document of its substrings."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.doc = [-1], [0], [_NEVER]

    def _state(self, size: int, steps: dict[bytes, int], link: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.size.append(size)
        self.doc.append(_NEVER)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of the longest substrings of ``q`` that end p's by ``word``."""
        if self.size[p] + 1 == self.size[q]:
            return q
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if doc < self.doc[last]:
                self.doc[last] = doc

    def close(self) -> None:
        """Hand the smallest documents on to all shorter substrings."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.doc[v] < self.doc[self.link[v]]:
                self.doc[self.link[v]] = self.doc[v]

    def statistics(self, words: list[bytes], width: int) -> Iterator[tuple[int, int]]:
        """``length, doc`` at each word: the longest match that ends there, and the smallest document with its last ``width`` words."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            v = state
            while v and self.size[self.link[v]] >= width:
                v = self.link[v]
            yield length, self.doc[v] if length >= width else _NEVER


_NEVER = 1 << 63


def repeated(passages: list[tuple[int, list[bytes]]], width: int) -> list[list[int]]:
    """For each ``doc, words`` the first words of the windows that a smaller document has, from one automaton of all of them."""
    known: dict[bytes, int] = {}
    for doc, words in passages:
        own = b" ".join(words)
        known[own] = min(doc, known.get(own, _NEVER))
    automaton = Automaton()
    for own, doc in known.items():
        automaton.add(own.split(b" "), doc)
    automaton.close()
    return [[i - width + 1 for i, (_, first) in enumerate(automaton.statistics(words, width)) if first < doc] for doc, words in passages]


def _answers(passages: list[tuple[int, list[bytes]]], width: int) -> list[list[int]]:
    """``repeated``, by automata of about SHARD words: passages that are more than two of these are taken apart into windows."""
    n = sum(len(words) for _, words in passages) // SHARD
    if n < 2:
        return repeated(passages, width)
    shards: list[list[tuple[int, int, list[bytes]]]] = [[] for _ in range(n * width)]  # each word is in up to ``width`` windows
    for k, (_, words) in enumerate(passages):
        for i in range(len(words) - width + 1):
            own = words[i : i + width]
            shards[xxhash.xxh3_64_intdigest(b" ".join(own)) % len(shards)].append((k, i, own))
    out: list[list[int]] = [[] for _ in passages]
    for shard in shards:
        for (k, i, _), starts in zip(shard, repeated([(passages[k][0], own) for k, _, own in shard], width)):
            out[k] += [i] * len(starts)
    return [sorted(starts) for starts in out]


def _shards(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Repeated spans; passages come sorted by fingerprint."""

        def settle(rows: list[tuple]) -> pd.DataFrame:
            out = []
            for (_, doc, nth, first, _), starts in zip(rows, _answers([(r[1] - r[2], r[4]) for r in rows], width)):
                for i in starts:
                    if out and out[-1][0] == doc and out[-1][1] <= first + i <= out[-1][2]:
                        out[-1] = (doc, out[-1][1], max(out[-1][2], first + i + width))
                    else:
                        out.append((doc, first + i, first + i + width))
            return pd.DataFrame(out, columns=["doc", "first", "last"])

        rows, n = [], 0
        for pdf in batches:
            for fp, doc, nth, first, words in zip(pdf["fp"].tolist(), pdf["doc"].tolist(), pdf["nth"].tolist(), pdf["first"].tolist(), pdf["words"]):
                if n > SHARD and rows[-1][0] != fp:
                    yield settle(rows)
                    rows, n = [], 0
                words = words.split(b" ")
                rows.append((fp, doc, nth, first, words))
                n += len(words)
        yield settle(rows)

    return run


def repeated_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, th, spans`` of the documents with repeated words; a span is struct(first, last), last excluded, and spans may overlap.

    ``th`` is xxhash64 of the text where texts share a doc_id, else null.
    """
    spark, gram, path = documents.sparkSession, min(GRAM, width), scratch(documents.sparkSession)
    keyed, names = text_keys(documents)
    nth = F.lit(0)
    if names is not None:
        low = names.groupBy("doc_id").agg(F.min("key").alias("low"))
        names = names.join(low, "doc_id").select(F.col("key").alias("doc"), F.col("doc_id").alias("name"), (F.col("key") - F.col("low")).cast("int").alias("nth"))
        keyed, nth = keyed.join(names.select(F.col("doc").alias("doc_id"), "nth"), "doc_id"), F.col("nth")
    docs = keyed.filter("text is not null").select(F.col("doc_id").alias("doc"), nth.alias("nth"), F.col("text").cast("binary").alias("bytes"))
    hot = spark.sparkContext.broadcast(hot_fingerprints(docs, width, gram))
    places = docs.mapInPandas(_places(width, gram, hot), _PLACE)
    dealt = places.repartition(F.when(F.col("known"), F.xxhash64("doc", "first")).otherwise(F.col("fp")))
    met = dealt.sortWithinPartitions("known", "fp", "c", F.col("doc") - F.col("nth"), "doc", "first").mapInPandas(_meet, _MET)
    met.write.partitionBy("kind").parquet(path)  # as files their size is known
    met = spark.read.schema(_MET).parquet(path)
    own = F.flatten(F.collect_set(F.array(F.col("fp"), F.col("first").cast("long"), F.col("last").cast("long"))))
    marks = met.filter("kind = 1").groupBy("doc").agg(own.alias("own"))
    parts = docs.dropDuplicates(["doc"]) if names is not None else docs
    parts = parts.join(marks, "doc").mapInPandas(_cut_out, "fp long, doc long, nth int, first int, words binary")
    shards = parts.repartition("fp").sortWithinPartitions("fp", "doc", "first").mapInPandas(_shards(width), _SPAN)
    spans = shards.unionByName(met.filter("kind = 0").select("doc", "first", "last"))
    spans = spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    if names is None:
        return spans.select(F.col("doc").alias("doc_id"), F.lit(None).cast("long").alias("th"), "spans")
    texts = docs.select("doc", F.xxhash64(F.col("bytes").cast("string")).alias("th")).distinct()
    return spans.join(names, "doc").join(texts, "doc").select(F.col("name").alias("doc_id"), "th", "spans")


def _kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for text, own in zip(texts.array, spans.array):
        if text is None:
            out.append((0, 0, None))
            continue
        words, kept, at = text.split(), [], 0
        bounds = own.tolist() if own is not None else []
        for first, last in zip(bounds[::2], bounds[1::2]):
            kept += words[at:first]
            at = max(at, last)
        kept += words[at:]
        out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def remove_passages(documents: DataFrame, width: int = WIDTH, column: str = "passages") -> DataFrame:
    """``documents`` with ``column``: struct(n_words, n_removed, kept), kept being the words that stay, joined by one space; a column of that name is replaced."""
    doc, th, spans = (fresh(documents, x) for x in ("_doc", "_th", "_spans"))
    found = repeated_spans(documents, width).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("spans").alias(spans))
    same = F.col(th).isNull() | (F.xxhash64("text") == F.col(th))
    df = documents.join(found, (F.col("doc_id") == F.col(doc)) & same, "left").drop(doc, th)
    kept = F.pandas_udf(_kept, "n_words long, n_removed long, kept string")
    return df.withColumn(column, kept(F.col("text").cast("binary"), F.flatten(F.transform(spans, lambda x: F.array(x["first"], x["last"]))))).drop(spans)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("passages.kept", F.lit("")).cast("binary")
    return out.select("doc_id", "passages.n_words", "passages.n_removed", F.sha2(kept, 256).alias("kept_sha256"))
