"""Operator 7: benchmark decontamination with a distributed positional inverted index.

1. Index.  One pass over the texts writes the postings as a Parquet table in the
   shared folder: a row holds a term, a block of documents and the term's positions in
   that block, and a row a document its place in the block and its number of words.
   Terms that the benchmark doesn't use are left out, unless it has more than
   ``MAX_TERMS`` of them; then all are indexed.
2. Look up.  The index tells how often each term occurs.  Every benchmark phrase starts
   from its rarest term: a join on the term gives the blocks that may hold it, and those
   without its second rarest term are dropped, as are phrases with a term that no text has.
3. Intersect.  Postings of blocks with a candidate are shuffled once, to their block; the list
   of such blocks is small and sent to the postings.  If all terms are indexed, those that no
   candidate needs are dropped before.  Blocks meet their candidate phrases, and each phrase
   intersects the posting lists of its terms, adjusted by their offsets, from the block's rarest
   on.  Proximity matches ask for all terms within ``span`` consecutive words.
4. Matches come back as one row a document, and items are joined to their phrases,
   salted where one phrase is in very many documents.

Blocks have about one size, so no join or group of the index has a hot key, and of the
benchmark only its distinct terms, at most MAX_TERMS longs, pass through the driver.

A word is a run of digits, ASCII letters and non-ASCII characters, A-Z lower-cased; a
term is a word's xxh3 hash of 64 bits.  A block is laid out whole, at about 60 bytes of memory a word;
a longer text is a block of its own.  Null texts have no words.  Items without words match
nothing; repeated item rows count once an item_id; items without an id are ignored.
Repeated rows of the documents get the same result each, rows that share only their
doc_id each their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import scratch
from .common import blocks, cut, fresh, join_hot, read, signed

WIDTH, SPAN = 13, 26
#: Bytes of text in a block; distinct benchmark terms that are sent to the tasks (8 bytes each).
BLOCK, MAX_TERMS = 4 << 20, 4_000_000

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_INDEX = "kind int, block long, term long, n int, first int, at binary, doc_id string, th long"


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Terms of all texts, one text after another, and each text's number of words."""
    words = [t.translate(_FOLD).split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    return signed(np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, count.sum())), count


def _phrases(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                terms = terms_of([text.encode("utf-8", "surrogatepass")])[0]
                for i in range(max(1, len(terms) - width + 1) if len(terms) else 0):
                    phrase = terms[i : i + width]
                    p1, p2 = np.frombuffer(xxhash.xxh3_128_digest(phrase.tobytes()), np.int64).tolist()
                    out.append((item, p1, p2, phrase.tolist()))
            yield pd.DataFrame(out, columns=["item", "p1", "p2", "terms"])

    return run


def _index(wanted, gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for low, high, texts in blocks(pdf, limit=BLOCK):
                block += 1
                terms, sizes = terms_of(texts)
                first = np.cumsum(sizes + gap) - sizes - gap
                at = np.arange(len(terms)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
                if wanted is not None:
                    place = np.searchsorted(wanted.value, terms)
                    held = wanted.value[np.minimum(place, len(wanted.value) - 1)] == terms if len(wanted.value) else np.zeros(len(terms), bool)
                    terms, at = terms[held], at[held]
                order = np.argsort(terms, kind="stable")
                terms, at = terms[order], at[order].astype("<i4")
                begin = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
                end = np.append(begin[1:], len(terms))
                yield pd.DataFrame({"kind": 0, "block": block, "term": 0, "n": sizes, "first": first, "at": b"", "doc_id": pdf["doc_id"].array[low:high], "th": pdf["th"].array[low:high]})
                if len(begin):
                    lists = [at[i:j].tobytes() for i, j in zip(begin.tolist(), end.tolist())]
                    yield pd.DataFrame({"kind": 1, "block": block, "term": terms[begin], "n": end - begin, "first": 0, "at": lists, "doc_id": None, "th": 0})

    return run


class Postings:
    """Posting lists of a block: sorted positions of each term; texts are a gap of positions apart."""

    def __init__(self, terms: np.ndarray, lists: list[bytes]):
        order = np.argsort(terms)
        self.terms = terms[order]
        self.lists = [np.frombuffer(lists[i], "<i4") for i in order]

    def of(self, term: int) -> np.ndarray:
        i = np.searchsorted(self.terms, term)
        return self.lists[i] if i < len(self.terms) and self.terms[i] == term else np.empty(0, "<i4")

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Positions where the phrase starts: lists adjusted by offset, intersected from the shortest on."""
        lists = [self.of(t) for t in terms]
        order = sorted(range(len(terms)), key=lambda k: len(lists[k]))
        found = lists[order[0]].astype(np.int64) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = lists[k]
            at = np.minimum(np.searchsorted(other, found + k), len(other) - 1)
            found = found[other[at] == found + k]
        return found

    def proximity(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Positions from which ``span`` consecutive words hold all terms, in any order; such that a term stands there."""
        lists = sorted((self.of(t) for t in np.unique(terms)), key=len)
        if not len(lists[0]):
            return np.empty(0, np.int64)
        start = np.unique(np.concatenate(lists)).astype(np.int64)
        for other in lists:
            if not len(start):
                break
            at = np.searchsorted(other, start)
            start = start[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] - start < span)]
        return start


def _answer(span: int | None):
    def run(key, candidates: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "no", "n_hit", "phrases", "near"]
        if not len(candidates) or not len(index):
            return pd.DataFrame([], columns=columns)
        docs = index[index["kind"] == 0].sort_values("first", kind="stable")
        lists = index[index["kind"] == 1]
        postings = Postings(lists["term"].to_numpy(np.int64), lists["at"].tolist())
        first = docs["first"].to_numpy(np.int64)
        hits: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, list[tuple[int, int]]] = {}
        close: dict[int, list[tuple[int, int]]] = {}
        text_of = lambda at: np.searchsorted(first, at, "right") - 1
        for p1, p2, terms in zip(candidates["p1"].tolist(), candidates["p2"].tolist(), candidates["terms"]):
            terms = np.asarray(terms, np.int64)
            at = postings.phrase(terms)
            texts = text_of(at)
            for t, x in zip(texts.tolist(), at.tolist()):
                hits.setdefault(t, []).append((x, x + len(terms)))
            for t in np.unique(texts).tolist():
                found.setdefault(t, []).append((p1, p2))
            if span is not None:
                for t in np.unique(text_of(postings.proximity(terms, span))).tolist():
                    close.setdefault(t, []).append((p1, p2))
        out = []
        for t in sorted(hits.keys() | close.keys()):
            reach = covered = 0
            for a, b in sorted(hits.get(t, [])):
                covered += max(0, b - max(a, reach))
                reach = max(reach, b)
            out.append((key[0], int(first[t]), covered, [{"p1": a, "p2": b} for a, b in found.get(t, [])], [{"p1": a, "p2": b} for a, b in close.get(t, [])]))
        return pd.DataFrame(out, columns=columns)

    return run


def _items(hits: DataFrame, column: str, owners: DataFrame) -> DataFrame:
    """``block, no, <column>``: sorted items of the phrases in ``column``."""
    of_doc = hits.select("block", "no", F.explode(column).alias("p")).select("block", "no", "p.p1", "p.p2")
    counted = owners.join(of_doc.groupBy("p1", "p2").agg(F.count("*").alias("n")), ["p1", "p2"])
    told = join_hot(of_doc, counted, ["p1", "p2"], "n", "block")
    return told.groupBy("block", "no").agg(F.sort_array(F.collect_set("item")).alias(column))


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 5, span: int | None = None) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, th (hash of the text), n_words, n_hit, items, near, contaminated.

    ``items`` holds the benchmark items with a window of ``width`` words (all words, if fewer) in
    the text, ``n_hit`` counts the words inside such windows, and a text with
    100 * n_hit >= percent * n_words > 0 hits is contaminated.  With ``span``, ``near`` holds the
    items of which all words of a window lie within ``span`` consecutive words; null without.
    """
    spark = documents.sparkSession
    known = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    phrases = cut(known.mapInPandas(_phrases(width), "item string, p1 long, p2 long, terms array<long>").dropDuplicates(["item", "p1", "p2"]))
    shapes = cut(phrases.select("p1", "p2", "terms").dropDuplicates(["p1", "p2"]))
    words = shapes.select("p1", "p2", F.posexplode("terms").alias("k", "term"))
    terms = cut(words.select("term").distinct())
    wanted = None
    if terms.count() <= MAX_TERMS:
        wanted = spark.sparkContext.broadcast(np.sort(terms.toPandas()["term"].to_numpy(np.int64)))
    path, gap = scratch(spark), max(width, span or 0) + 1
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    rows.mapInPandas(_index(wanted, gap), _INDEX).write.partitionBy("kind").parquet(path)
    index, lists = spark.read.schema(_INDEX).parquet(path), spark.read.schema(_INDEX).parquet(path).filter("kind = 1")
    often = cut(lists.groupBy("term").agg(F.sum("n").alias("n")))
    rarest = join_hot(words, often, ["term"], "n", "p1").groupBy("p1", "p2").agg(F.count("*").alias("found"), F.slice(F.sort_array(F.collect_set(F.struct("n", "term"))), 1, 2).alias("rarest"))
    lookup = shapes.join(rarest, ["p1", "p2"]).filter(F.col("found") == F.size("terms"))
    lookup = lookup.select("p1", "p2", "terms", F.get("rarest", F.lit(0))["term"].alias("term"), F.element_at("rarest", -1)["term"].alias("second"))
    # as files their sizes are known, so Spark sends what is small to the postings instead of shuffling these
    held = lists.select("term", "block")  # one row a term and block
    candidates = _stored(held.join(_stored(lookup), "term").drop("term"))
    candidates = _stored(held.withColumnRenamed("term", "second").join(candidates, ["second", "block"]).drop("second"))
    # one long a block of BLOCK bytes, so a few thousand for tens of GB
    touched = _stored(candidates.select("block").distinct())
    postings = index
    if wanted is None:
        needed = _stored(candidates.select("block", F.explode("terms").alias("term")).distinct())
        postings = index.filter("kind = 0").unionByName(lists.join(needed, ["block", "term"], "left_semi").select(*index.columns))
    postings = postings.join(F.broadcast(touched), "block", "left_semi").select("block", "kind", "term", "n", "first", "at")
    pair = "array<struct<p1:long,p2:long>>"
    hits = candidates.groupBy("block").cogroup(postings.groupBy("block")).applyInPandas(_answer(span), f"block long, no int, n_hit long, phrases {pair}, near {pair}")
    hits = cut(hits)
    owners = phrases.select("item", "p1", "p2")
    found = hits.select("block", "no", "n_hit").join(_items(hits, "phrases", owners).withColumnRenamed("phrases", "items"), ["block", "no"], "left")
    if span is not None:
        found = found.join(_items(hits, "near", owners), ["block", "no"], "left")
    none = F.array().cast("array<string>")
    docs = index.filter("kind = 0").select("block", F.col("first").alias("no"), F.col("doc_id").cast("long").alias("doc_id"), "th", F.col("n").cast("long").alias("n_words"))
    out = docs.join(found, ["block", "no"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    near = F.coalesce("near", none) if span is not None else F.lit(None).cast("array<string>")
    hit = (n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), near.alias("near"), hit.alias("contaminated"))


def mark_contamination(documents: DataFrame, benchmark: DataFrame, column: str = "contamination", **options) -> DataFrame:
    """``documents`` with ``column``: struct(n_words, n_hit, items, near, contaminated); a column of that name is replaced."""
    found = find_contamination(documents, benchmark, **options).dropDuplicates(["doc_id", "th"])
    doc, th, told = fresh(documents, "_doc"), fresh(documents, "_th"), fresh(documents, "_told")
    found = found.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.struct("n_words", "n_hit", "items", "near", "contaminated").alias(told))
    out = documents.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left").drop(doc, th)
    return out.withColumn(column, F.col(told)).drop(told)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that are not contaminated (see ``find_contamination``), as they are."""
    bad = find_contamination(documents, benchmark, **options).filter("contaminated").select("doc_id", "th").distinct()
    doc, th = fresh(documents, "_doc"), fresh(documents, "_th")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("th").alias(th))
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: items of which all words of a window lie within SPAN consecutive words of a text."""
    out = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), span=SPAN)
    return out.select("doc_id", "n_words", F.size("items").cast("long").alias("n_items"), F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items"))
