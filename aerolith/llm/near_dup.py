"""Operator 1: near-duplicate groups by SetSketch registers.

A document's set holds its distinct word shingles.  Its sketch has ``M``
registers ``floor(1 - log_b(h))`` of exponentially distributed minima ``h``: the
registers of a union are the larger ones of both, and two sets agree in a
register with about their Jaccard similarity.

1. One pass over the texts gives set size, a 128-bit name of the set, sketch.
2. Documents with the same set are one class; only classes go on.
3. Bands of ``ROWS`` registers are bucket keys.  Inside a bucket a pair's similarity
   is estimated jointly from both sketches and set sizes by maximum likelihood; of the
   pairs that may be linked a spanning forest goes on, at most one pair a member.
4. Connected pairs make clusters.  Texts are shuffled once, by cluster, and links are
   confirmed on full sets there, again only until the members hang together.
5. A bucket of more than ``BUCKET`` or a cluster of more than ``CLUSTER`` members does
   not meet in one task.  Its members lie in blocks, and pivots meet all blocks of their
   bucket, a row of two blocks at a time.  The first round has one pivot, which ties a
   group of copies of any size; each next round has eight times as many, taken from what
   is not tied to the bucket's largest group, until all of that have been pivots: some
   log8(members) rounds whatever the members are.  Where links are confirmed, blocks carry
   the hashed sets, not the texts.  A pair is tested once at most: in the bucket of the
   first band that it shares, when the first of the two is a pivot, and only if nothing has
   tied the two before.
6. Smallest ids spread over the links until nothing changes.

Shingles are known by 64 bits, from xxh3 hashes of their words.  Null or wordless texts have the empty set and
link with nothing; a null doc_id takes no part (component null, kept).  Rows that share doc_id
and text are one document.  Rows that share only their doc_id are documents of their own, with
the doc_id as their name: each joins what its own text is linked with.  A text is laid out whole,
at about 200 bytes of memory a word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut, mix, read, text_keys

#: Registers, registers in a band, base of the register scale.  A pair at 0.8 misses all 42 bands
#: with a chance under 3 in a million, one at 0.9 under 1 in 10**13.
M, ROWS, BASE = 256, 6, 1.02
#: Members of a bucket, and classes and bytes of a cluster, that meet in one task.
BUCKET, CLUSTER, CLUSTER_BYTES = 2_000, 4_000, 16 << 20
#: Members of a block of a larger bucket, and shingles where blocks carry sets.
MEET, MEET_SHINGLES = 256, 1 << 20
#: Estimate from which a pair may be linked: five standard errors under 0.8.
MAY_LINK = 0.68

#: Odd multipliers of the words of a shingle.
_MIX = np.random.default_rng(20240601).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOG_BASE = np.log(BASE)


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and each text's count."""
    words = [t.lower().split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, n_words.sum())
    first, size = np.cumsum(n_words) - n_words, np.minimum(n_words, width)
    count = np.where(n_words == 0, 0, n_words - size + 1)
    of = np.repeat(np.arange(len(texts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[of]
    h = size[of].astype(np.uint64)
    for k in range(width):
        some = size[of] > k
        h[some] += word[at[some] + k] * _MIX[k % len(_MIX)]
    h = mix(h)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.bincount(of[new], minlength=len(texts))


def sketches(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """SetSketch registers of each set, as an array (sets, M).

    Each element is the seed of a Poisson process of rate M whose points fall in
    random registers, which gives every register independent Exp(1) values.  Points
    come in rising order, so an element is left as soon as it is past the largest
    minimum that its set still has to beat.
    """
    n = len(count)
    low = np.full((n, M), np.inf)
    flat = low.reshape(-1)
    of = np.repeat(np.arange(n), count)
    reach = (np.log(M) + 4) / np.maximum(count, 1)  # fills all registers of most sets
    state, value = h.copy(), np.zeros(len(h))

    def draw(which: np.ndarray) -> None:
        state[which] += np.uint64(0x9E3779B97F4A7C15)
        uniform = ((mix(state[which]) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        value[which] -= np.log(uniform) / M

    live = np.arange(len(h))
    draw(live)
    while True:
        live = live[value[live] <= reach[of[live]]]
        if len(live):
            register = (mix(mix(state[live]) ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.int64)
            np.minimum.at(flat, of[live] * M + register, value[live])
            draw(live)
            continue
        open_ = (count > 0) & (low.max(axis=1) > reach)
        if not open_.any():
            break
        reach[open_] *= 1.5  # points drawn past the old horizon wait in value and state
        live = np.flatnonzero(open_[of])
    low[count == 0] = 1.0
    return np.clip(np.floor(1 - np.log(low) / _LOG_BASE), 0, 32767).astype(np.int16)


def _sketch_batches(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last, texts in blocks(pdf):
                h, count = shingle_sets(texts, width)
                registers = sketches(h, count)
                names, at = [], 0
                for c in count:
                    names.append(xxhash.xxh3_128_digest(h[at : at + c].tobytes()) if c else None)
                    at += c
                yield pd.DataFrame({"doc_id": pdf["doc_id"].array[first:last], "th": pdf["th"].array[first:last], "n_shingles": count, "class_key": names, "sketch": [r.tobytes() for r in registers]})

    return run


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches (rows) whose set sizes are known."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = M - more - less
    u = (n_a / (n_a + n_b))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG_BASE
    up, down = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    score = more * np.log(up + 1e-12) + less * np.log(down + 1e-12) + same * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], 1)[:, 0]


class Forest:
    """Union of numbered members; the smallest number of a group is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x
        return x != y


def span(registers: np.ndarray, test) -> tuple[Forest, list[tuple[int, int]]]:
    """Groups of the members whose pairs pass ``test(x, y)`` (arrays in, booleans out), and the pairs that made them.

    Pairs come most similar first, and those inside a group are not tested any more.
    """
    n = len(registers)
    forest, made, found = Forest(n), [], []
    for i in range(n - 1):
        same = (registers[i] == registers[i + 1 :]).sum(axis=1)
        j = np.flatnonzero(same >= (MAY_LINK - 0.05) * M)
        if len(j):
            found.append(np.stack([np.full(len(j), i), j + i + 1, same[j]]).astype(np.int32))
    if not found:
        return forest, made
    x, y, same = np.concatenate(found, axis=1)
    order = np.argsort(-same, kind="stable")
    x, y = x[order], y[order]
    for k in range(0, len(x), 256):
        roots = np.array([forest.root(i) for i in range(n)]) if k % 4096 == 0 else roots
        some = np.flatnonzero(roots[x[k : k + 256]] != roots[y[k : k + 256]]) + k
        some = np.array([i for i in some if forest.root(int(x[i])) != forest.root(int(y[i]))], int)
        if len(some):
            for i in some[test(x[some], y[some])]:
                if forest.join(int(x[i]), int(y[i])):
                    made.append((int(x[i]), int(y[i])))
    return forest, made


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of rows that come sorted by ``key``."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        keys = pdf[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for low, high in zip(np.append(0, cuts[:-1]), cuts):
            yield pdf.iloc[low:high]
        rest = pdf.iloc[cuts[-1] :] if len(cuts) else pdf
    if rest is not None and len(rest):
        yield rest


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of the pairs that may be linked, of every bucket; rows come sorted by bucket."""
    out = []
    for group in _grouped(batches, "bucket"):
        if len(group) < 2:
            continue
        registers = np.frombuffer(b"".join(group["sketch"]), np.int16).reshape(-1, M)
        reps, n = group["rep"].to_numpy(), group["n_shingles"].to_numpy(float)
        _, made = span(registers, lambda x, y: likelihood_jaccard(registers[x], registers[y], n[x], n[y]) >= MAY_LINK)
        out += [(reps[x], reps[y]) for x, y in made]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    yield pd.DataFrame(out, columns=["a", "b"])


def _clusters(width: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Exact components of every cluster; rows come sorted by cluster."""
        for group in _grouped(batches, "cluster"):
            reps = group["rep"].to_numpy()
            h, count = shingle_sets([t.encode("utf-8", "surrogatepass") for t in group["text"]], width)
            sets = np.split(h, np.cumsum(count)[:-1])

            def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)])
                return 100 * both >= percent * (count[x] + count[y] - both)

            forest, _ = span(sketches(h, count), linked)
            roots = np.array([forest.root(i) for i in range(len(reps))])
            low = np.full(len(reps), np.iinfo(np.int64).max)
            np.minimum.at(low, roots, reps)
            yield pd.DataFrame({"node": reps, "component": low[roots]})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, last, texts in blocks(pdf):
                h, count = shingle_sets(texts, width)
                stop = np.cumsum(count)
                yield pd.DataFrame({"rep": pdf["rep"].array[first:last], "set": [h[i:j].tobytes() for i, j in zip(stop - count, stop)]})

    return run


def on_full_sets(percent: int):
    """A test of pairs of block members: links on their whole sets."""

    def test(members: list, pivots: list, pairs: list[tuple[int, int]]) -> list[bool]:
        held: dict[tuple[int, int], np.ndarray] = {}
        out = []
        for x, y in pairs:
            for side, block, i in ((0, members, x), (1, pivots, y)):
                if (side, i) not in held:
                    held[side, i] = np.frombuffer(block[i]["set"], np.uint64)
            u, v = held[0, x], held[1, y]
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * both >= percent * (len(u) + len(v) - both))
        return out

    return test


def _block_pairs(test):
    """``a, b`` of members and pivots of two blocks that may be linked and pass ``test``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for members, pivots, band in zip(pdf["members"], pdf["pivots"], pdf["band"]):
                rep, n, tied = (np.array([m[c] for m in members]) for c in ("rep", "n_shingles", "component"))
                pivot = np.array([bool(m["pivot"]) for m in members])
                registers = np.frombuffer(b"".join(m["sketch"] for m in members), np.int16).reshape(-1, M)
                pairs = []
                for y, p in enumerate(pivots):
                    own = np.frombuffer(p["sketch"], np.int16)
                    # of two pivots the larger meets the smaller one
                    meet = (tied != p["component"]) & (rep != p["rep"]) & ~(pivot & (rep > p["rep"]))
                    near = np.flatnonzero(meet & ((registers == own).sum(axis=1) >= (MAY_LINK - 0.05) * M))
                    if len(near) and band:
                        # an earlier band that both share has a bucket of its own
                        before = band * ROWS
                        near = near[~(registers[near, :before] == own[:before]).reshape(len(near), band, ROWS).all(axis=2).any(axis=1)]
                    if len(near):
                        likeness = likelihood_jaccard(registers[near], np.broadcast_to(own, (len(near), M)), n[near].astype(float), np.full(len(near), float(p["n_shingles"])))
                        pairs += [(x, y) for x in near[likeness >= MAY_LINK].tolist()]
                passed = test(members, pivots, pairs) if test is not None else [True] * len(pairs)
                out += [(int(rep[x]), pivots[y]["rep"]) for (x, y), good in zip(pairs, passed) if good]
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, classes: DataFrame, name: str, block: str) -> DataFrame:
    """``bucket, band, <block>, <name>``: members with their sketches, about MEET of a bucket in a block."""
    kinds = [c for c in classes.columns if c in ("n_shingles", "sketch", "set")]
    rows = rows.join(classes.select("rep", *kinds), "rep")
    fill = F.count("*") / MEET
    fill = F.ceil(F.greatest(fill, F.sum("n_shingles") / MEET_SHINGLES) if "set" in kinds else fill)
    sizes = rows.groupBy("bucket").agg(fill.alias("_blocks"))
    dealt = rows.join(sizes, "bucket").withColumn(block, F.pmod(F.xxhash64("rep"), F.col("_blocks")))
    return dealt.groupBy("bucket", "band", block).agg(F.collect_list(F.struct("rep", "component", "pivot", *kinds)).alias(name))


def tie_up(rows: DataFrame, classes: DataFrame, test=None) -> tuple[DataFrame, int]:
    """Pairs ``a, b`` that tie together the members of each bucket of ``rows(bucket, band, rep)``, and the number of rounds.

    ``classes`` has ``n_shingles`` and ``sketch`` of each rep, and ``set`` if the test reads it.  ``test(members,
    pivots, pairs)`` tells which pairs of indexes hold of those that may be linked; all do without it.  Pivots
    meet all of their bucket, so what is left apart at the end has no tie to any member outside the
    bucket's largest group.
    """
    rows = cut(rows.select("bucket", "band", "rep").distinct())
    placed = apart = cut(rows.withColumn("component", F.col("rep")))
    used, ties = None, None
    for turn in itertools.count():
        few = apart.groupBy("bucket").agg(F.count("*").alias("_n"), F.min("rep").alias("_first"))
        chance = F.pmod(F.xxhash64(F.lit(turn), "rep"), F.lit(1 << 30)) / F.lit(1 << 30)
        taken = (F.col("rep") == F.col("_first")) | ((F.lit(turn) > 0) & (chance < F.lit(8**turn) / F.col("_n")))
        pivots = cut(apart.join(few, "bucket").filter(taken).select("bucket", "band", "rep", "component", F.lit(True).alias("pivot")))
        # earlier pivots have met all of their bucket
        others = placed if used is None else placed.join(used, ["bucket", "rep"], "left_anti")
        others = others.join(pivots.select("bucket", "rep", "pivot"), ["bucket", "rep"], "left")
        blocks_ = _in_blocks(others, classes, "members", "block")
        meet = _in_blocks(pivots, classes, "pivots", "_pivots").select("bucket", "pivots")
        pairs = blocks_.join(meet, "bucket").select("members", "pivots", "band").mapInPandas(_block_pairs(test), "a long, b long")
        ties = cut(pairs.distinct() if ties is None else ties.union(pairs.distinct()))
        used = cut(pivots.select("bucket", "rep") if used is None else used.union(pivots.select("bucket", "rep")))
        groups = connected(ties).withColumnRenamed("node", "rep")
        placed = cut(rows.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep")).select("bucket", "band", "rep", "component"))
        main = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        apart = cut(placed.join(main, "bucket").filter("component <> main").join(used, ["bucket", "rep"], "left_anti").select("bucket", "band", "rep", "component"))
        if apart.isEmpty():
            return ties, turn + 1


def may_links(bands: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` that tie together all that may be linked, at most one a member and bucket, and the shared buckets."""
    shared = cut(bands.join(bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "bucket"))
    members = shared.filter(F.col("n") <= BUCKET).select("bucket", "rep").join(classes.select("rep", "n_shingles", "sketch"), "rep")
    ties = members.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_forests, "a long, b long")
    large = shared.filter(F.col("n") > BUCKET).select("bucket", "band", "rep")
    if not large.isEmpty():
        ties = ties.union(tie_up(large, classes)[0])
    return ties.distinct(), shared.select("bucket", "band", "rep")


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest id) of undirected links ``a, b``: large-star and small-star steps until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    total = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).filter("u <> v").distinct()
        edges = cut(small)
        # a forest of stars: the sum of roots falls with every step until it stands still
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if now == total:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        total = now


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``documents(doc_id, text)``: doc_id, th (xxhash64 of the text), n_shingles, component_id, kept, class_id.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets
    of ``width``-word shingles; a component's smallest doc_id is kept.
    """
    if percent < 80:
        raise ValueError("bands and bounds are laid out for similarities of 0.8 and more")
    docs, names = text_keys(documents)
    # a null id takes no part, but has its row
    rows = documents.select("doc_id", "text") if names is None else docs.unionByName(documents.filter("doc_id is null").select("doc_id", "text"))
    # ids go through pandas as text: beside a null, longs would turn into doubles
    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    sets = named.mapInPandas(_sketch_batches(width), "doc_id string, th long, n_shingles long, class_key binary, sketch binary")
    sets = cut(sets.withColumn("doc_id", F.col("doc_id").cast("long")))
    classes = cut(sets.filter("n_shingles > 0 and doc_id is not null").groupBy("class_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    n_bands, step = M // ROWS, 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * step + 1, F.lit(step))))
    pairs, shared = may_links(classes.select("rep", F.posexplode(keys).alias("band", "bucket")), classes)
    clusters = connected(pairs).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    clusters = clusters.unionByName(clusters.select(F.col("cluster").alias("rep"), "cluster").distinct()).distinct()
    sized = cut(clusters.join(docs.select(F.col("doc_id").alias("rep"), F.octet_length("text").alias("size")), "rep").dropDuplicates(["rep"]))
    whole = sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    fits = whole.select("cluster", ((F.col("n") <= CLUSTER) & (F.col("bytes") <= CLUSTER_BYTES)).alias("fits"))
    sized = cut(sized.select("rep", "cluster").join(fits, "cluster"))
    texts = sized.join(docs.withColumnRenamed("doc_id", "rep"), "rep").dropDuplicates(["rep"])
    groups = texts.filter("fits").repartition("cluster").sortWithinPartitions("cluster").mapInPandas(_clusters(width, percent), "node long, component long")
    large = sized.filter("not fits")
    if not large.isEmpty():
        held = cut(texts.filter("not fits").select("rep", "text").mapInPandas(_sets(width), "rep long, set binary"))
        members, whole_sets = shared.join(large.select("rep"), "rep", "left_semi"), classes.join(held, "rep")
        groups = groups.unionByName(connected(tie_up(members, whole_sets, on_full_sets(percent))[0]))
    part = classes.select("class_key", F.col("rep").alias("class_id")).join(groups.withColumnRenamed("node", "class_id").groupBy("class_id").agg(F.min("component").alias("component")), "class_id", "left")
    out = sets.select("doc_id", "th", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_key")).alias("class_key")).join(part, "class_key", "left")
    own = F.coalesce("class_id", "doc_id")
    out = out.select("doc_id", "th", "n_shingles", F.coalesce("component", own).alias("component_id"), own.alias("class_id"))
    for column in ("doc_id", "component_id", "class_id") if names is not None else ():
        out = out.join(names.select(F.col("key").alias(column), F.col("doc_id").alias("_name")), column, "left").withColumn(column, F.col("_name")).drop("_name")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "th", "n_shingles", "component_id", kept.alias("kept"), "class_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=4).drop("th")
