"""Operator 5: exact removal of repeated substrings by sampled suffixes.

A byte goes if a ``WIDTH``-byte string that covers it also starts earlier in the
corpus (smaller doc_id, or same document and earlier start).  Matches don't cross
documents.

This is not the induced sort that the operator is named after: no suffix array is
built.  Inducing one byte after another from a priority queue was measured at 12.8
microseconds a byte in Python, for the top level alone, without recursion, common
prefixes or disk: 12,800 CPU seconds a GB.  What is kept of it is the sample that
decides the rest: suffixes are sampled by content, sorted and compared by a bounded
prefix on Spark's external sorter, and windows between samples follow from them.

Sample: in every window of ``WIDTH`` bytes the smallest hash of its ``GRAM``-byte
strings is selected.  Equal windows select alike, so each selected suffix owns the
run of windows that selected it, and two windows can only be equal if their owners
start with the same ``GRAM`` bytes at the same distance.

1. The sampled suffixes are sorted by (first bytes, owned span, doc_id, start), both by
   hash.  In a run of suffixes with equal spans the first is kept and the others'
   windows go at once.
2. Only where suffixes share the first bytes but not the span do the first ones of the
   runs still have windows in common.  Their spans meet by first bytes, and of equal
   windows all but the first go.
3. First bytes that very many different spans share (the edges of a passage in a third
   of all documents) never meet as a group: a bounded sample of documents tells them
   beforehand, their suffixes are dealt by the whole span, and their single windows are
   sorted by content.  Both ways are exact, so the sample only decides who takes which.

Before each shuffle a task settles what repeats inside it, so a passage that a third
of all documents share sends about one suffix a task, not one a copy.  Equal hashes
(128 bits) are taken as equal spans.

Null text is empty.  Rows with a null doc_id are left as they are and take no
part.  Rows that share doc_id and text are one document and get the same result; rows
that share only the doc_id are documents one after another, in the order of a hash of
their texts.  Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeHash, Seen, cut, mix, read, signed, text_keys

#: Bytes of a repeated string, bytes of the sampled strings, bytes that are hashed together.
WIDTH, GRAM, PIECE = 100, 40, 1 << 20
#: Different spans of one gram that meet in one task; bits of a packed run length.
GROUP, RUN_BITS = 2_000, 20
#: Documents of the sample that tells hot grams, its documents that make one hot, grams that are told at most.
SAMPLE, HOT, MOST_HOT = 20_000, 20, 20_000

_GRAMS, _SPANS = RangeHash(50001), RangeHash(50002)
_INDEX_BITS = np.uint64(24)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges; ranges that touch join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], np.append(reach[:-1][new[1:]], reach[-1])


def _pieces(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks ``(buffer, first, row, shift)``: texts end to end; a text beyond PIECE bytes comes in
    pieces that overlap by WIDTH - 1 bytes; ``shift`` is the piece's place in its text."""
    held, rows, shifts, size = [], [], [], 0
    for row, text in enumerate(pdf["text"].array):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        for at in range(0, max(len(raw) - WIDTH + 1, 0), PIECE - WIDTH + 1):
            piece = raw[at : at + PIECE]
            if held and size + len(piece) > PIECE:
                yield held, rows, shifts
                held, rows, shifts, size = [], [], [], 0
            held.append(piece)
            rows.append(row)
            shifts.append(at)
            size += len(piece)
    if held:
        yield held, rows, shifts


def _owners(buffer: np.ndarray, sizes: np.ndarray):
    """Of the windows inside texts: group number's first window, last window and owner's position."""
    sums = _GRAMS.prefix(buffer)
    at = np.arange(len(buffer) - GRAM + 1)
    grams = _GRAMS.of(sums, at, at + GRAM)
    key = (grams >> _INDEX_BITS) << _INDEX_BITS | at.astype(np.uint64)  # leftmost of equal hashes
    span, low = 1, key
    while span * 2 <= WIDTH - GRAM + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WIDTH - GRAM + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    owner = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(owner)]
    inside = np.arange(len(owner)) + WIDTH <= ends[text]
    start = np.flatnonzero(inside)
    new = np.append(True, (np.diff(owner[start]) != 0) | (np.diff(text[start]) != 0))
    first = start[new]
    last = np.append(start[np.flatnonzero(new)[1:] - 1], start[-1])
    return first, last, owner[first], text[first], grams


#: ``place`` packs first window, number of further windows, whether the gram is hot, and whether the windows are known
#: to go: rows are sorted by it.
_ROW = "k1 long, k2 long, doc_id long, place long"


def _pack(first: np.ndarray, last: np.ndarray, hot: np.ndarray | bool, gone: bool) -> np.ndarray:
    return (first << (RUN_BITS + 2)) | ((last - first) << 2) | (np.asarray(hot).astype(np.int64) << 1) | int(gone)


def _unpack(place: str = "place"):
    """Columns first, last, hot, gone."""
    first = F.shiftright(place, RUN_BITS + 2)
    bit = lambda k: F.shiftright(place, k).bitwiseAND(F.lit(1).cast("long")) == 1
    return first, first + F.shiftright(place, 2).bitwiseAND(F.lit((1 << RUN_BITS) - 1)), bit(1), bit(0)


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return signed(mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)))


def _frame(k1, k2, doc, first, last, gone, hot) -> pd.DataFrame:
    """Rows of a block; what is decided already is merged and gets keys of its own."""
    out = [pd.DataFrame({"k1": signed(k1[~gone]), "k2": signed(k2[~gone]), "doc_id": doc[~gone], "place": _pack(first[~gone], last[~gone], hot[~gone], False)})]
    if gone.any():
        d, s, e = doc[gone], first[gone], last[gone]
        order = np.lexsort((s, d))
        d, s, e = d[order], s[order], e[order]
        # windows that follow one another without a gap are one row, up to a quarter of what a run can pack
        new = np.append(True, (d[1:] != d[:-1]) | (s[1:] > e[:-1] + 1) | (s[1:] >> (RUN_BITS - 2) != s[:-1] >> (RUN_BITS - 2)))
        to = np.append(np.flatnonzero(new)[1:] - 1, len(d) - 1)
        out.append(pd.DataFrame({"k1": _spread(d[new], s[new]), "k2": 0, "doc_id": d[new], "place": _pack(s[new], e[to], False, True)}))
    return pd.concat(out, ignore_index=True)


def _suffixes(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """``gram, span, doc, first, last`` of the sampled suffixes of each block."""
    ids = pdf["doc_id"].to_numpy(np.int64)
    for held, rows, shifts in _pieces(pdf):
        buffer, sizes = np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])
        first, last, owner, text, grams = _owners(buffer, sizes)
        # the span's hash holds the owner's distance too
        span = mix(_SPANS.of(_SPANS.prefix(buffer), first, last + WIDTH) ^ (owner - first).astype(np.uint64))
        move = (np.array(shifts) - np.cumsum(sizes) + sizes)[text]
        yield grams[owner], span, ids[np.array(rows)[text]], first + move, last + move


def _samples(hot):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            for gram, span, doc, first, last in _suffixes(pdf):
                gone = seen.later([doc, first], gram, span)
                wide = np.isin(signed(gram), hot.value)
                yield _frame(np.where(wide, mix(gram ^ span), gram), span, doc, first, last, gone, wide)

    return run


def _gram_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every gram of a document once, with each of its spans once a block."""
    for pdf in batches:
        for gram, span, _, _, _ in _suffixes(pdf):
            pair = np.unique(np.stack([signed(gram), signed(span)]), axis=1)
            k1, n = np.unique(pair[0], return_counts=True)
            yield pd.DataFrame({"k1": k1, "n": n})


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams that at least HOT different spans of about SAMPLE documents share."""
    share = F.lit(SAMPLE / max(docs.count(), 1))
    some = docs.filter(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(1 << 30)) / (1 << 30) < share)
    counts = some.mapInPandas(_gram_documents, "k1 long, n long").groupBy("k1").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT)
    return np.sort(np.array([r["k1"] for r in counts.orderBy(F.desc("n"), "k1").limit(MOST_HOT).collect()], np.int64))


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the open spans of gathered groups."""
    for pdf in batches:
        out = []
        for doc, text, ranges in zip(pdf["doc_id"], pdf["text"], pdf["open"]):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            out += [(r["k1"], doc, r["first"], raw[r["first"] : r["last"] + WIDTH]) for r in ranges if not r["wide"] and r["last"] + WIDTH <= len(raw)]
        if out:
            yield pd.DataFrame(out, columns=["k1", "doc_id", "first", "span"])


def _common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows with an earlier equal one, of rows sorted by (k1, doc_id, first)."""
    gram, seen, before = None, set(), None
    for pdf in batches:
        out = []
        for k1, doc, first, span in zip(pdf["k1"], pdf["doc_id"], pdf["first"], pdf["span"]):
            if k1 != gram:
                gram, seen = k1, set()
            elif (doc, first) == before:
                continue  # a repeated row of the documents
            before = doc, first
            low = None
            for i in range(len(span) - WIDTH + 1):
                window = span[i : i + WIDTH]
                if window in seen:
                    low = i if low is None else low
                else:
                    seen.add(window)
                    if low is not None:
                        out.append((doc, first + low, first + i - 1))
                        low = None
            if low is not None:
                out.append((doc, first + low, first + len(span) - WIDTH))
        yield pd.DataFrame(out, columns=["doc_id", "first", "last"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Single windows of the open spans of groups that are too large to meet in a task."""
    seen = Seen()
    for pdf in batches:
        k1, k2, docs, starts = [], [], [], []
        for doc, text, ranges in zip(pdf["doc_id"], pdf["text"], pdf["open"]):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b"", np.uint8)
            for r in ranges:
                if not r["wide"] or r["last"] + WIDTH > len(raw):
                    continue
                part = raw[r["first"] : r["last"] + WIDTH]
                at = np.arange(len(part) - WIDTH + 1)
                k1.append(_GRAMS.of(_GRAMS.prefix(part), at, at + WIDTH))
                k2.append(_SPANS.of(_SPANS.prefix(part), at, at + WIDTH))
                docs.append(np.full(len(at), doc))
                starts.append(at + r["first"])
        if k1:
            k1, k2, doc, start = (np.concatenate(x) for x in (k1, k2, docs, starts))
            yield _frame(k1, k2, doc, start, start, seen.later([doc, start], k1, k2), np.zeros(len(doc), bool))


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, a, b in zip(pdf["text"], pdf["gone_a"], pdf["gone_b"]):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            ranges = [(r["first"], r["last"] + WIDTH) for x in (a, b) if x is not None for r in x]
            start, end = merge(*np.array(ranges, np.int64).reshape(-1, 2).T)
            start, end = np.minimum(start, len(raw)), np.minimum(end, len(raw))
            edges = [0, *(x for pair in zip(start, end) for x in pair), len(raw)]
            kept = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            out.append((len(raw), int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.concat([pdf[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])], axis=1)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes)."""
    docs, names = text_keys(documents)
    held = docs.sparkSession.sparkContext.broadcast(hot_grams(docs))  # MOST_HOT longs at most
    suffixes = docs.mapInPandas(_samples(held), _ROW)
    by_start = Window.partitionBy("k1", "k2").orderBy("doc_id", "place")
    by_gram = Window.partitionBy("k1").orderBy("k2", "doc_id", "place")
    whole = by_gram.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, hot, gone = _unpack()
    # all windows share one exchange and one sort
    ranked = suffixes.withColumn("kinds", hot | (F.first("k2").over(whole) != F.last("k2").over(whole))).withColumn("rows", F.count("*").over(whole)).withColumn("rank", F.rank().over(by_start))
    later = gone | (F.col("rank") > 1)
    span = F.struct(first.alias("first"), last.alias("last"))
    open_span = F.struct("k1", first.alias("first"), last.alias("last"), (hot | (F.col("rows") > GROUP)).alias("wide"))
    told = ranked.filter(later | F.col("kinds")).groupBy("doc_id").agg(F.collect_list(F.when(later, span)).alias("gone_a"), F.collect_list(F.when(~later & F.col("kinds"), open_span)).alias("open"))
    told = cut(told)
    open_ = docs.join(told.filter(F.size("open") > 0).select("doc_id", "open"), "doc_id")
    spans = open_.mapInPandas(_spans, "k1 long, doc_id long, first long, span binary")
    found = spans.repartition("k1").sortWithinPartitions("k1", "doc_id", "first").mapInPandas(_common, "doc_id long, first long, last long")
    if not told.filter(F.exists("open", lambda x: x["wide"])).isEmpty():
        single = open_.mapInPandas(_windows, _ROW).withColumn("rank", F.rank().over(by_start)).filter(later)
        found = found.unionByName(single.select("doc_id", first.alias("first"), last.alias("last")))
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("gone_b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = docs.join(told.select("doc_id", "gone_a"), "doc_id", "left").join(found, "doc_id", "left").mapInPandas(_cut_out, schema)
    if names is not None:
        out = out.withColumnRenamed("doc_id", "key").join(names, "key").drop("key")
    none = F.lit(None).cast("array<struct<first:long,last:long>>")
    unnamed = documents.filter("doc_id is null").select("doc_id", "text", none.alias("gone_a"), none.alias("gone_b"))
    return out.unionByName(unnamed.mapInPandas(_cut_out, schema))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
