"""Operator 6: removal of repeated runs of lines by winnowing over line hashes.

A run is a sequence of whole lines that starts and ends with a line that has words
and holds ``MIN_WORDS`` words or more.  Every line goes that lies in a run which also
starts earlier in the corpus (smaller doc_id, or same document and earlier line).
Lines are equal if they are after trimming white space.

1. Index.  One pass over the texts keeps the 128-bit hash and the number of words of
   each line; from here on no text is read until lines are cut out.
2. Winnow.  A window is the shortest run from a line on.  Of each window the smallest
   line hash (the last of equal ones) is selected; equal windows select alike, so two
   equal runs are sure to share a selected position.  Positions that several windows
   select are one row.
3. Join.  A selected hash that stands at a single position of the corpus is no match.
   The positions of the others go back to the line index of their document.
4. Extend.  From each window with a matched position the match grows both ways: on to
   the shortest run from its start, back from every line at which a run that opens
   there is first long enough, and over blank lines between two lines that are long
   enough alone.  A line of a repeated run of any length lies in one of these, and
   they are repeated with the run, so their union is the union of all repeated runs,
   whichever earlier copy each part of a run agrees with.  (Growing against the
   earliest copy only would lose what a third copy shares with the second alone;
   growing against all copies would be all pairs of a group.)
5. Delete.  Grown runs meet by content, each against the earliest place of its content;
   lines of later ones go.

What repeats inside a task is settled there, so a passage in a third of all documents
sends about one row a task to step 5; earliest places are combined before the shuffle
and joined back salted.  Null text has no lines; a null doc_id takes no part and stays
as it is.  Rows that share doc_id and text are one document, rows that share only the
doc_id are several, in the order of a hash of their texts.  A text that loses all lines
is empty, its row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Seen, blocks, cut, fresh, join_hot, read

MIN_WORDS, BLOCK = 50, 2 << 20
_INDEX = "doc_id long, th long, hashes binary, words binary"
_RUN = "c1 long, c2 long, doc_id long, th long, first int, last int, gone boolean"


def line_index(text: bytes) -> tuple[bytes, np.ndarray]:
    """128-bit hashes of the trimmed lines, one after another, and their numbers of words."""
    lines = [x.strip() for x in text.split(b"\n")]
    return b"".join(map(xxhash.xxh3_128_digest, lines)), np.fromiter((len(x.split()) for x in lines), np.uint32, len(lines))


def _index(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last, texts in blocks(pdf, limit=BLOCK):
                found = [line_index(t) for t in texts]
                held = [i for i, (_, n) in enumerate(found) if n.sum() >= min_words]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array[first:last][held], "th": pdf["th"].array[first:last][held], "hashes": [found[i][0] for i in held], "words": [found[i][1].tobytes() for i in held]})

    return run


def _windows(hashes: bytes, words: bytes, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words a line and before it, last line of the window that opens at each line (-1: none), line that it selects."""
    n = np.frombuffer(words, np.uint32).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(n)])
    last = np.searchsorted(total, total[:-1] + min_words) - 1  # total[last + 1] is the first to reach it
    last[(last >= len(n)) | (n == 0)] = -1
    key = np.frombuffer(hashes, ">u8")[::2]
    chosen = np.full(len(n), -1)
    for i in np.flatnonzero(last >= 0):
        j = last[i]
        chosen[i] = j - key[i : j + 1][::-1].argmin()
    return n, total, last, chosen


def _winnow(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, texts, at, prints = [], [], [], []
            for doc, th, hashes, words in zip(pdf["doc_id"], pdf["th"], pdf["hashes"], pdf["words"]):
                chosen = np.unique(_windows(hashes, words, min_words)[3])
                chosen = chosen[chosen >= 0]
                docs.append(np.full(len(chosen), doc))
                texts.append(np.full(len(chosen), th))
                at.append(chosen)
                prints.append(np.frombuffer(hashes, ">i8")[::2][chosen])
            if docs:
                doc, th, line, fp = (np.concatenate(x).astype(np.int64) for x in (docs, texts, at, prints))
                yield pd.DataFrame({"fingerprint": fp, "doc_id": doc, "th": th, "line": line})

    return run


def grown_runs(hashes: bytes, words: bytes, marks: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Runs ``first, last`` that the windows with a matched position in ``marks`` grow to."""
    n, total, last, chosen = _windows(hashes, words, min_words)
    matched = np.isin(chosen, marks) & (chosen >= 0)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1  # total[back] is the last that leaves enough
    spans = {(int(i), int(last[i])) for i in np.flatnonzero(matched)}
    spans |= {(int(i), j) for j, i in enumerate(back) if i >= 0 and n[j] and matched[i]}
    worded = np.flatnonzero(n)
    spans |= {(i, j) for i, j in zip(worded[:-1].tolist(), worded[1:].tolist()) if j > i + 1 and n[i] >= min_words <= n[j] and matched[i]}
    return sorted(spans)


def _grow(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            rows, names = [], []
            for doc, th, hashes, words, marks in zip(pdf["doc_id"], pdf["th"], pdf["hashes"], pdf["words"], pdf["marks"]):
                for i, j in grown_runs(hashes, words, np.asarray(marks), min_words):
                    rows.append((doc, th, i, j))
                    names.append(xxhash.xxh3_128_digest(hashes[16 * i : 16 * j + 16]))
            if rows:
                doc, th, first, last = np.array(rows, np.int64).T
                c1, c2 = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2).T
                yield pd.DataFrame({"c1": c1, "c2": c2, "doc_id": doc, "th": th, "first": first, "last": last, "gone": seen.later([doc, th, first], c1, c2)})

    return run


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, th, runs`` of the texts with repeated lines; th is xxhash64 of the text, a run struct(first, last) from 0; runs may overlap."""
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    index = cut(docs.mapInPandas(_index(min_words), _INDEX))
    positions = index.mapInPandas(_winnow(min_words), "fingerprint long, doc_id long, th long, line int")
    # repeated rows of a document are one position
    positions = cut(positions.distinct())
    matched = positions.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    marks = join_hot(positions, matched, ["fingerprint"], "n", "doc_id").groupBy("doc_id", "th").agg(F.collect_list("line").alias("marks"))
    runs = cut(index.join(marks, ["doc_id", "th"]).mapInPandas(_grow(min_words), _RUN))
    open_ = runs.filter("not gone").drop("gone")
    place = F.struct("doc_id", "th", "first")
    lead = open_.groupBy("c1", "c2").agg(F.min(place).alias("lead"), F.count("*").alias("n")).filter("n > 1")
    later = join_hot(open_, lead, ["c1", "c2"], "n", "doc_id").filter(place > F.col("lead"))
    gone = later.select("doc_id", "th", "first", "last").unionByName(runs.filter("gone").select("doc_id", "th", "first", "last"))
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))


def remove_repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """``documents`` with ``text`` without repeated lines; n_chars follows the text if it exists.

    With ``counts`` the columns ``n_lines`` and ``n_removed`` are set; no other column changes.
    """
    doc, th, runs, gone = (fresh(documents, x) for x in ("_doc", "_th", "_runs", "_gone"))
    found = repeated_lines(documents, min_words).select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("runs").alias(runs))
    df = documents.join(found, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left").drop(doc, th)
    lines = F.split("text", "\n")
    removed = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"]))))
    df = df.withColumn(gone, F.when(F.col(runs).isNotNull(), removed))
    kept = F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))), lambda i: F.get(lines, i)), "\n")
    if counts:
        df = df.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    df = df.withColumn("text", F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        df = df.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.drop(runs, gone)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_kept"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
