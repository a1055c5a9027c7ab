"""Operator 4: language identification by prediction by partial matching.

Per language a byte context tree of orders 0 to 3 holds symbol counts.  A symbol
that a context has not seen costs that context's escape (method C: distinct
symbols over total plus distinct) and is then coded by the shorter context, with
the longer context's symbols excluded.  Statistics are frozen after training, so
each (context, byte) has one exact code length; all are laid out in tables and
a text's code length is a sum of look-ups.  The shortest code wins.

No context is left out: languages are dealt to tables of about ``table_bytes``, a
language that needs more has one of its own, and code lengths don't depend on which
languages share a table.  A text passes once over each table.

A-Z is folded to a-z.  Training reads about ``max_docs`` documents a language, by
hash of the id; rows without lang or text are ignored.  A text that is null or has no
letters is ``und`` with score 0; so is every text if nothing could be learned.  On a
tie the first language by name wins.  Repeated rows each get their row; other columns
stay, but for ``lang_pred`` and ``lang_score``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, crc_bucket, fresh, read

#: Documents a language that the trees learn from; bytes of a table of code lengths.
MAX_DOCS, TABLE_BYTES = 2_000, 48 << 20

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PAD = b"\n\n\n"


@dataclass
class Table:
    languages: list[int]
    symbol: np.ndarray  # byte -> symbol
    row: np.ndarray  # last three symbols -> row of the longest context held
    bits: np.ndarray  # (row * symbols + symbol, language) -> code length


@dataclass
class Trees:
    languages: list[str]
    tables: list[Table]


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of the padded texts, and the position of each text's first byte."""
    buffer = _FOLD[np.frombuffer(b"".join(x for t in texts for x in (_PAD, t)), np.uint8)]
    sizes = np.array([len(t) + 3 for t in texts])
    return buffer, np.cumsum(sizes) - sizes + 3


def _four_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            for _, _, texts in blocks(part, limit=8 << 20):
                b, first = _codes(texts)
                if len(b) < 4:
                    continue
                b = b.astype(np.uint32)
                code = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
                pad = np.zeros(len(b), bool)
                for k in (1, 2, 3):
                    pad[first - k] = True
                code, n = np.unique(code[~pad[3:]], return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n})


def train(documents: DataFrame, max_docs: int = MAX_DOCS, table_bytes: int = TABLE_BYTES) -> Trees:
    """Trees from ``documents(doc_id, text, lang)``; rows without lang or text are ignored."""
    docs = documents.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Trees([], [])
    pick = F.pmod(F.xxhash64(F.lit("tree"), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, max_docs / sizes[lang]))))
    grams = docs.filter(pick < share[F.col("lang")]).mapInPandas(_four_grams, "lang string, code long, n long")
    table = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    return _trees(languages, table, table_bytes)


def _trees(languages: list[str], table: pd.DataFrame, table_bytes: int) -> Trees:
    code, n = table["code"].to_numpy(np.int64), table["n"].to_numpy(float)
    lang = np.searchsorted(languages, table["lang"].to_numpy(str)) if len(table) else np.empty(0, int)
    groups: list[list[int]] = []
    rows = size = 0
    for i in range(len(languages)):
        own = code[lang == i] >> 8
        rows += len(np.unique(own)) + len(np.unique(own & 0xFFFF)) + 256
        size = max(size, len(np.unique(own & 255)) + 1)
        if not groups or rows * size * (len(groups[-1]) + 1) * 4 > table_bytes:
            groups.append([])
            rows = len(np.unique(own)) + len(np.unique(own & 0xFFFF)) + 256
        groups[-1].append(i)
    tables = []
    for group in groups:
        held = np.isin(lang, group)
        tables.append(_table(group, np.searchsorted(group, lang[held]), code[held], n[held]))
    return Trees(languages, tables)


def _table(group: list[int], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Table:
    """Code lengths of the languages of ``group`` after every context that one of them has seen."""
    seen = np.unique(np.concatenate([(code >> s) & 255 for s in (0, 8, 16, 24)] + [[10]]))
    size = len(seen) + 1  # the last symbol stands for all other bytes
    symbol = np.full(256, size - 1, np.int32)
    symbol[seen] = np.arange(len(seen))
    a, b, c, d = (symbol[(code >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0))
    full = (a * size + b) * size + c
    n_lang = len(group)
    pairs, deep = np.unique(b * size + c), np.unique(full)

    def counts(index: np.ndarray, rows: int) -> np.ndarray:
        held = index >= 0
        out = np.zeros((n_lang, rows, size))
        np.add.at(out, (lang[held], index[held], d[held]), n[held])
        return out

    def place(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, -1)

    def code_context(own: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of contexts with counts ``own`` that escape to ``shorter``."""
        total, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        rest = np.where(own > 0, 0, shorter)
        left = rest.sum(-1, keepdims=True)
        p = np.where(own > 0, own / np.maximum(total + kinds, 1), kinds / np.maximum(total + kinds, 1) * rest / np.maximum(left, 1e-300))
        return np.where(total > 0, p, shorter)

    base = np.append(np.full(len(seen), 1 / 256), max(256 - len(seen), 1) / 256)
    p0 = code_context(counts(np.zeros(len(code), int), 1), np.broadcast_to(base / base.sum(), (n_lang, 1, size)))
    p1 = code_context(counts(c, size), p0)
    p2 = code_context(counts(place(pairs, b * size + c), len(pairs)), p1[:, pairs % size])
    parent = place(pairs, deep % (size * size))
    below = np.concatenate([p1, p2], axis=1)
    p3 = code_context(counts(place(deep, full), len(deep)), below[:, np.where(parent >= 0, size + parent, deep % size)])
    p = np.concatenate([p1, p2, p3], axis=1)
    bits = -np.log2(np.maximum(p, 1e-30))
    bits[..., -1] += np.log2(max(256 - len(seen), 1))
    last = np.arange(size, dtype=np.int32)
    two = np.tile(last, size)
    two[pairs] = size + np.arange(len(pairs))
    row = np.tile(two, size)
    row[deep] = size + len(pairs) + np.arange(len(deep))
    return Table(group, symbol, row.astype(np.int32), np.ascontiguousarray(bits.transpose(1, 2, 0).reshape(-1, n_lang), np.float32))


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Code length in bits of each text (rows) under each language (columns)."""
    out = np.zeros((len(texts), len(trees.languages)))
    long = [i for i, t in enumerate(texts) if t]
    if not long:
        return out
    b, first = _codes([texts[i] for i in long])
    for t in trees.tables:
        size = t.bits.shape[0] // (int(t.row.max()) + 1)
        s = t.symbol[b]
        cost = t.bits[t.row[(s[:-3] * size + s[1:-2]) * size + s[2:-1]] * size + s[3:]]
        for k in (1, 2, 3):
            cost[(first - k)[1:] - 3] = 0  # padding between texts
        out[np.ix_(long, t.languages)] = np.add.reduceat(cost, first - 3, axis=0, dtype=np.float64)
    return out


def predict(documents: DataFrame, trees: Trees) -> DataFrame:
    """``documents`` with ``lang_pred`` and ``lang_score``, the posterior of the language under equal priors."""
    held = documents.sparkSession.sparkContext.broadcast(trees)  # some MB a language, whatever the corpus

    @F.pandas_udf("lang_pred string, lang_score double")
    def identify(texts: pd.Series) -> pd.DataFrame:
        model, names, scores = held.value, [], []
        pdf = texts.to_frame("text")
        for first, last, raw in blocks(pdf, limit=1 << 18):
            bits = code_lengths(model, raw) if model.languages else np.zeros((len(raw), 1))
            best = bits.argmin(axis=1)
            posterior = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            for text, i, p in zip(texts.array[first:last], best, posterior):
                known = bool(model.languages) and isinstance(text, str) and _LETTER.search(text) is not None
                names.append(model.languages[i] if known else "und")
                scores.append(float(p) if known else 0.0)
        return pd.DataFrame({"lang_pred": names, "lang_score": scores})

    told = fresh(documents, "_l")
    return documents.withColumn(told, identify("text")).withColumns({"lang_pred": F.col(told)["lang_pred"], "lang_score": F.col(told)["lang_score"]}).drop(told)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = train(docs.filter(crc_bucket("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
