"""Operator 2: counterfactual-regularised toxicity classifier.

A logistic model over words that occur, words that make up a share of a text, and
such word stems (the first bytes of longer words).  Every labelled text that names a group
has twins in which the identity terms are swapped for those of other groups, or masked,
word by word, and all features are those of the new words;
the loss adds ``penalty`` times the squared difference of both scores, so that
naming a group is no evidence by itself.

The model is fitted on at most ``max_rows`` labelled rows, those of the smallest
hash of their id; the vocabulary comes from the same rows.  Scoring covers every
whole text.  Null, empty and wordless texts get the score of no evidence; with
no labelled rows every score is 0, and with labels of one kind only about that label.
Repeated rows get equal scores, repeated labels of a document count once.  All columns
of the documents stay, but for one that bears the name of the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, read

# Identity terms; the terms of a line stand for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("young", "old", "elderly", "disabled", "blind", "deaf"),
    ("immigrants", "refugees", "migrants", "foreigners", "natives", "citizens"),
)
#: One in so many words makes a word or stem dense; bytes of a stem.
DENSE, STEM = 150, 6
#: Places in its line by which a term moves in a text's twins; number of the twin without terms.
SHIFTS, NAMELESS = (1, 3), 99
#: Bounds of the fit.
MAX_ROWS, MAX_WORDS, MIN_DOCS = 20_000, 4_000, 4

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


def features(words: list[bytes]) -> set[bytes]:
    """Words, ``+word`` and ``^stem`` where dense."""
    counts, least = Counter(words), len(words) / DENSE
    stems = Counter([w[:STEM] for w in words if len(w) > STEM])
    return {*counts, *(b"+" + w for w, n in counts.items() if n >= least), *(b"^" + w for w, n in stems.items() if n >= least)}


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[bytes, float] = field(default_factory=dict)

    def logit(self, text: str | None) -> float:
        found = features(tokens(text))
        return self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & found))


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 256):  # a word of a text is a row: a batch at once would be large
            part = pdf.iloc[k : k + 256]
            found = [(row, toxic, shift, features(words)) for row, toxic, text in zip(part["row"], part["toxic"], part["text"]) for shift, words in twins(tokens(text))]
            sizes = [len(f[-1]) for f in found]
            row, toxic, shift = (np.repeat(np.array([f[k] for f in found], np.int64), sizes) for k in range(3))
            yield pd.DataFrame({"row": row, "toxic": toxic, "shift": shift, "word": [w for f in found for w in f[-1]]})


def _swaps(shift: int) -> dict[bytes, bytes]:
    return {t.encode(): group[(k + shift) % len(group)].encode() for group in IDENTITY_TERMS for k, t in enumerate(group)}


#: The mask keeps the number of words, so no other word turns dense; it is no word of any text.
_SWAPS = {**{shift: _swaps(shift) for shift in SHIFTS}, NAMELESS: dict.fromkeys(_swaps(0), b"")}


def twins(words: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """``shift, words``: the text itself (shift 0) and, if it names a group, its twins."""
    named = not _SWAPS[NAMELESS].keys().isdisjoint(words)
    return [(0, words), *((shift, [swap.get(w, w) for w in words]) for shift, swap in _SWAPS.items() if named)]


def _term_features() -> set[bytes]:
    """All features that a term can give."""
    terms = {t.encode() for group in IDENTITY_TERMS for t in group}
    return {*terms, *(b"+" + t for t in terms), *(b"^" + t[:STEM] for t in terms if len(t) > STEM)}


def bounded(labels: DataFrame, max_rows: int) -> DataFrame:
    """``doc_id, toxic, row`` of at most ``max_rows`` labels, those of the smallest hash ``row``.

    Only hashes are sorted, and only about as many as the bound.
    """
    rows = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").dropDuplicates(["doc_id"])
    rows = rows.withColumn("row", F.xxhash64(F.lit("fit"), F.col("doc_id")))
    n = rows.count()
    if n <= max_rows:
        return rows
    share = F.lit(int(min(1.0, 1.33 * max_rows / n) * (1 << 20)) + 1)
    # rows are taken by the top 20 bits of the hash first; the bound's own hash then cuts exactly
    rows = rows.filter(F.shiftrightunsigned("row", 44) < share)
    cut_at = rows.select("row").orderBy("row").limit(max_rows).agg(F.max("row")).first()[0]
    return rows.filter(F.col("row") <= cut_at)


def fit(documents: DataFrame, labels: DataFrame, penalty: float = 5.0, ridge: float = 1e-4, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, min_docs: int = MIN_DOCS) -> Model:
    """Fit on ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``; null and repeated labels are ignored."""
    known = labels.join(documents.select("doc_id"), "doc_id", "left_semi")
    rows = documents.select("doc_id", "text").join(bounded(known, max_rows), "doc_id").select("row", "toxic", "text").persist()
    try:
        sizes = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return Model(30.0 if 1 in sizes else -30.0)
        found = rows.mapInPandas(_feature_rows, "row long, toxic int, shift int, word binary").persist()
        counts = found.filter("shift = 0").groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).filter(F.col("n") >= min_docs)
        # the words whose log odds are most surely not 0, by a z score with half a case added
        pos, neg = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
        odds = F.log(pos / (sizes[1] - F.col("pos") + 0.5)) - F.log(neg / (sizes[0] - F.col("n") + F.col("pos") + 0.5))
        spread = F.sqrt(1 / pos + 1 / neg)
        chosen = counts.withColumn("z", F.abs(odds) / spread).filter("z > 3").orderBy(F.desc("z"), "word").limit(max_words)
        vocabulary = [bytes(r["word"]) for r in chosen.collect()]
        vocabulary = sorted({*vocabulary, *_term_features()})
        index = {w: i for i, w in enumerate(vocabulary)}
        cells = found.join(F.broadcast(rows.sparkSession.createDataFrame([(w, i) for w, i in index.items()], "word binary, word_no int")), "word")
        cells = cells.groupBy("row", "shift").agg(F.sort_array(F.collect_list("word_no")).alias("cells"))
        data = rows.select("row", "toxic").join(cells, "row", "left").orderBy("row", "shift").toPandas()
        found.unpersist()
    finally:
        rows.unpersist()
    return _descend(data, vocabulary, penalty, ridge)


def _descend(data: pd.DataFrame, vocabulary: list[bytes], penalty: float, ridge: float, steps: int = 400) -> Model:
    held: dict[int, dict[int, np.ndarray]] = {}
    for row, shift, cells in zip(data["row"], data["shift"].fillna(0).astype(int), data["cells"]):
        held.setdefault(row, {})[shift] = np.asarray(cells, int) if cells is not None else np.empty(0, int)
    none = np.empty(0, int)  # neither a wordless text nor a text of terms without them has cells
    lists = [cells.get(0, none) for cells in held.values()]
    named = [cells for cells in held.values() if any(cells.keys())]
    twin_a = [cells[0] for cells in named for _ in _SWAPS]
    twin_b = [cells.get(shift, none) for cells in named for shift in _SWAPS]
    y = data.drop_duplicates("row")["toxic"].to_numpy(float)

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.empty(0, int)]).astype(int), len(rows)

    def scores(w: np.ndarray, x) -> np.ndarray:
        return np.bincount(x[0], w[x[1]], x[2])

    def back(g: np.ndarray, x) -> np.ndarray:
        return np.bincount(x[1], g[x[0]], len(vocabulary))

    x, xa, xb = flat(lists), flat(twin_a), flat(twin_b)
    w, bias, m, v = np.zeros(len(vocabulary)), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(scores(w, x) + bias, -40, 40)))
        g = back((p - y) / len(y), x) + ridge * w
        if twin_a:
            gap = scores(w, xa) - scores(w, xb)
            g += penalty * (back(gap, xa) - back(gap, xb)) / len(twin_a)
        full = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(float(bias), {word: float(x) for word, x in zip(vocabulary, w) if abs(x) > 1e-9})


def score(documents: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``documents`` with ``column`` (0 to 1), which replaces one of that name."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS words

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        logits = np.array([held.value.logit(t) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(logits, -40, 40))))

    return documents.withColumn(column, toxicity("text"))


def train_model(documents: DataFrame, labels: DataFrame, **options) -> Model:
    """Model from the labels of documents outside the held-out fifth (crc32 of the id modulo 5 is 0)."""
    return fit(documents, labels.filter(crc_bucket("doc_id", 5) != 0), **options)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train_model(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
