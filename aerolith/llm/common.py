"""Shared helpers of the training-data operators.

Text is handled as UTF-8 bytes inside tasks.  Batches of documents are laid out
as one byte buffer, so hashing is a few numpy passes over the buffer instead of
a Python call per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut

__all__ = ["BLOCK_BYTES", "RangeHash", "Seen", "blocks", "crc_bucket", "cut", "fresh", "join_hot", "mix", "read", "signed", "text_keys"]

#: Bytes of text that one numpy pass lays out together.
BLOCK_BYTES = 1 << 20
#: Rows from which a key's join is salted, and over how many tasks.
HOT_ROWS, SALTS = 2_000, 64

_U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name`` with underscores before it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, told: DataFrame, key: list[str], count: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``told``, one row a ``key``, whose ``count`` says how many rows a key has.

    Keys of more than HOT_ROWS rows meet salted by ``spread``, so the rows of one key are dealt to
    SALTS tasks; told's rows of those keys, few by their count, are repeated as often.
    """
    salt, is_hot = fresh(rows, "_salt"), fresh(rows, "_is_hot")
    hot = told.filter(F.col(count) > HOT_ROWS).withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(is_hot, F.lit(True))
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    met = dealt.join(hot, [*key, salt], "left")
    rest = met.filter(F.col(is_hot).isNull()).select(*rows.columns).join(told.filter(F.col(count) <= HOT_ROWS), key)
    return met.filter(is_hot).drop(salt, is_hot).unionByName(rest)


def text_keys(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text`` of the rows with a doc_id, such that equal doc_ids have equal texts, and what the new ids stand for.

    Mostly that holds already, which a count per doc_id tells without reading a text: then the second
    result is None.  Else (doc_id, hash of the text) pairs are numbered in order, range by range, and
    the second result is ``key, doc_id``.
    """
    docs = documents.filter("doc_id is not null").select("doc_id", "text")
    repeated = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs, None
    pairs = docs.select("doc_id", F.xxhash64("text").alias("th"))
    if pairs.join(repeated, "doc_id", "left_semi").distinct().groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs, None
    place = F.monotonically_increasing_id()  # partition above 33 bits of the row's place in it
    # ranges come from a sample, so they are written once
    ranges = cut(pairs.distinct().repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    numbers = ranges.join(before, part == F.col("_part")).select("doc_id", "th", (F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).alias("key"))
    numbers = cut(numbers)
    keyed = docs.withColumn("th", F.xxhash64("text")).join(numbers, ["doc_id", "th"])
    return keyed.select(F.col("key").alias("doc_id"), "text"), numbers.select("key", "doc_id")


def crc_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in bucket 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % modulus


def blocks(pdf: pd.DataFrame, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive row ranges ``(first, last, texts)`` of about ``limit`` bytes; null texts are empty."""
    first, size, out = 0, 0, []
    for i, text in enumerate(pdf[column].array):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if out and size + len(raw) > limit:
            yield first, i, out
            first, size, out = i, 0, []
        out.append(raw)
        size += len(raw)
    if out:
        yield first, first + len(out), out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class RangeHash:
    """64-bit hashes of any byte ranges of a buffer, from one prefix sum.

    Each byte value stands for a random 64-bit number and position ``i`` weighs
    ``base**i``; a range's sum is shifted back by the inverse power, so equal
    bytes hash alike wherever they stand.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**61)) * 8 + 5  # 5 modulo 8: its powers have the longest period
        self.inverse = pow(self.base, -1, 2**64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.multiply.accumulate(np.concatenate([np.ones(1, _U64), np.full(n, self.base, _U64)]))
            self.back = np.multiply.accumulate(np.concatenate([np.ones(1, _U64), np.full(n, self.inverse, _U64)]))

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        n = len(buffer)
        if n >= len(self.power):
            self._grow(max(n, BLOCK_BYTES + (BLOCK_BYTES >> 2)))
        sums = np.zeros(n + 1, _U64)
        np.cumsum(self.table[buffer] * self.power[:n], out=sums[1:])
        return sums

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.back[start] + (end - start).astype(_U64))


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return x.view(np.int64)


class Seen:
    """Places at which repeated keys of two longs were first met in a task, at most ``most`` of them.

    ``later`` tells the rows of a block whose keys also have an earlier place (columns, compared in
    order), in the block or among the keys that an earlier block of the task held twice or more.  A key
    that a large share of all documents hold so leaves a task about once, not once a block.  What is
    not remembered is told after the shuffle.
    """

    def __init__(self, most: int = 1 << 17):
        self.most = most
        self.keys: dict[tuple[int, int], tuple[int, ...]] = {}
        self.firsts = np.empty(0, np.int64)  # sorted first longs of most of the keys

    def later(self, place: list[np.ndarray], k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        n = len(k1)
        order = np.lexsort((*reversed(place), k2, k1))
        same = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
        start = np.flatnonzero(np.append(True, ~same)[:n])
        size = np.diff(np.append(start, n))
        leads = order[start]
        lead = np.repeat(leads, size)
        gone = np.zeros(n, bool)
        for p in place:
            gone[order] |= p[lead] != p[order]
        if len(self.firsts):
            own = k1[leads].view(np.int64)
            at = np.minimum(np.searchsorted(self.firsts, own), len(self.firsts) - 1)
            for i in np.flatnonzero(self.firsts[at] == own).tolist():
                name = int(k1[leads[i]]), int(k2[leads[i]])
                held = self.keys.get(name)
                if held is None:
                    continue
                row = tuple(int(p[leads[i]]) for p in place)
                if held > row:
                    self.keys[name] = row
                else:
                    for k in order[start[i] : start[i] + size[i]]:
                        gone[k] = tuple(int(p[k]) for p in place) != held
        for i in np.flatnonzero(size > 1)[: max(self.most - len(self.keys), 0)].tolist():
            self.keys.setdefault((int(k1[leads[i]]), int(k2[leads[i]])), tuple(int(p[leads[i]]) for p in place))
        if 8 * len(self.keys) > 9 * len(self.firsts):
            self.firsts = np.sort(np.fromiter((a for a, _ in self.keys), k1.dtype, len(self.keys)).view(np.int64))
        return gone
