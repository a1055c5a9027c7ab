"""Operator 11: importance resampling towards a target distribution.

1. Words.  A 256-byte table lower-cases A-Z and turns every separator into a space, so
   ``bytes.split`` yields the words of a text in UTF-8.  Texts are split in pieces of about
   ``PIECE`` bytes, so a very long text is never held as words at once.
2. Features.  All runs of 1 to ``n`` words, joined by one space.  The crc32 of a run is the
   seed of the run that is one word longer, so no joined string is made.  Counters reduce
   repeated words first; a feature's bucket is its crc32 modulo ``buckets``.
3. Gains.  Tasks hold one array of ``buckets`` counts each, which Spark adds up for the
   documents and the target.  A bucket's gain is the log ratio of its smoothed shares, in
   thousandths, floored.
4. Weights.  A second pass sums the gains of each text.  Only the ``buckets`` gains are sent
   to the tasks.
5. Draw.  Gumbel noise from a hash of the doc_id is added to the weight, and the highest
   scores are the sample (Gumbel top-k: drawing without replacement in proportion to
   exp(weight / 1000)).  Ranks are numbered range by range, no task sorts all scores.

Null, empty or wordless texts have no features and weight 0; of fewer than ``least`` words a text
is never drawn.  A null doc_id counts in the statistics, but has no score, no rank, and is none of
the N.  Rows that share a doc_id are rows of their own with the same noise.  Ties go to the smaller
doc_id.  An empty target or no documents give gains of the smoothing alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, read

#: Longest run of words, number of buckets, share drawn in percent, fewest words of a drawn text, seed.
N, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024
PIECE = 1 << 20
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None, keep: int = 0, limit: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """``held, words`` of each piece of a text: its words after the last ``keep`` words, ``held`` of them, of the piece before."""
    low, last = 0, []
    size = len(text) if text is not None else 0
    while low < size:
        high = low + limit
        if high < size:
            # a word's bytes never stand on both sides of a cut
            while high < size and _FOLD[text[high]] != 32:
                high += 1
        words = text[low:high].translate(_FOLD).split()
        yield len(last), last + words
        last = (last + words)[-keep:] if keep else []
        low = high


def count_features(words: list[bytes], held: int, n: int, counts: Counter) -> None:
    """Add the crc32 of all runs of 1 to ``n`` words that end after the first ``held`` words."""
    for word, times in Counter(words[held:]).items():
        counts[crc32(word)] += times
    seeds = list(map(crc32, words)) if n > 1 else []
    for k in range(1, n):
        seeds = [crc32(b" " + word, seed) for seed, word in zip(seeds, words[k:])]
        counts.update(seeds[max(0, held - k) :])


def _bucket_counts(n: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            counts: Counter = Counter()
            for text in pdf["bytes"].array:
                for held, words in words_of(text, n - 1):
                    count_features(words, held, n, counts)
                if len(counts) > 1_000_000:
                    _add(total, counts)
            _add(total, counts)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held, "n": total[held]})

    return run


def _add(total: np.ndarray, counts: Counter) -> None:
    at = np.fromiter(counts.keys(), np.int64, len(counts)) % len(total)
    np.add.at(total, at, np.fromiter(counts.values(), np.int64, len(counts)))
    counts.clear()


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all rows of ``texts(text)`` by bucket, empty buckets left out."""
    parts = texts.select(F.col("text").cast("binary").alias("bytes")).mapInPandas(_bucket_counts(n, buckets), "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, from all rows of both tables; ``buckets`` numbers of each come to the driver."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, table in ((s, documents), (t, target)):
        for row in bucket_counts(table, n, buckets).collect():
            counts[row["bucket"]] = row["n"]
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def with_weights(documents: DataFrame, gain: np.ndarray, column: str = "importance", n: int = N) -> DataFrame:
    """``documents`` with ``column``: struct(n_words, n_features, weight), weight being the floored mean gain of the features."""
    shared = documents.sparkSession.sparkContext.broadcast(gain.tolist())

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        gain, out = shared.value, []
        for text in texts.array:
            n_words = n_features = total = 0
            for held, words in words_of(text, n - 1):
                counts: Counter = Counter()
                count_features(words, held, n, counts)
                n_words += len(words) - held
                n_features += sum(counts.values())
                total += sum(gain[crc % len(gain)] * times for crc, times in counts.items())
            out.append((n_words, n_features, total // n_features if n_features else 0))
        return pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return documents.withColumn(column, weigh(F.col("text").cast("binary")))


def with_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighted(doc_id, weight)`` with ``score``: the weight plus Gumbel noise of the doc_id, in thousandths; null without a doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """``scored(doc_id, n_words, score, ...)`` with ``rank``: 1, 2, 3... of the drawn rows, highest score first, else null.

    Of the N rows with a score and at least ``least`` words floor(percent * N / 100) are drawn.
    """
    tie, place, part, before = (fresh(scored, x) for x in ("_tie", "_place", "_part", "_before"))
    rows = cut(scored)
    may = F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False))
    # the tie breaker spreads rows that share score and doc_id over ranges
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col(tie).asc()]
    ranges = rows.filter(may).withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # ranges come from a sample, so they are written once; a place is its partition above 33 bits of the row in it
    ranges = cut(ranges.withColumn(place, F.monotonically_increasing_id()).withColumn(part, F.shiftright(place, 33)).drop(tie))
    sizes = ranges.groupBy(part).agg(F.count("*").alias("_n"))
    starts = sizes.select(part, (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias(before))  # one row a range
    drawn = ranges.count() * percent // 100
    rank = F.col(before) + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = ranges.join(F.broadcast(starts), part).withColumn("rank", F.when(rank <= drawn, rank)).select(*rows.columns, "rank")
    return ranked.unionByName(rows.filter(~may).withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    docs = documents.select("doc_id", "text")
    weighted = with_weights(docs, gains(docs, target, n, buckets), "w", n).select("doc_id", "w.n_words", "w.n_features", "w.weight")
    return draw(with_scores(weighted, seed), percent, least)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
