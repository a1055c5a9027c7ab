"""Operator 11 against a plain version, with runs of one and of three words."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from aerolith.llm import resampling


def features(text, n):
    lower = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n, buckets, percent, least, seed):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(crc32(f) % buckets for f in features(text, n)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        n_words, own = features(text, n)
        weight = math.floor(sum(gain[crc32(f) % buckets] for f in own) / len(own)) if own else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, n_words, len(own), weight, score))
    may = sorted((r for r in rows if r[4] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    drawn = len(may) * percent // 100
    rank = {id(r): i + 1 for i, r in enumerate(may[:drawn])}
    return Counter((*r, rank.get(id(r))) for r in rows)


DOCS = [(i, f"Alpha beta {i % 7} gamma-delta, É{i % 3} " * (i % 9) + "tail\tEnd_of it" * (i % 4)) for i in range(200)]
DOCS += [(7, "alpha beta two"), (None, "alpha " * 30), (900, None), (901, ""), (902, "!? \n"), (903, "word" * 2000), (904, "one two " * 4000), (905, "x" * 50 + " y " * 500)]
TARGET = ["Beta gamma delta 1 2 3", None, "", "alpha alpha", "É1 tail"]


@pytest.mark.parametrize("n, piece", [(1, 1 << 20), (3, 1 << 20), (3, 50), (1, 7)])
def test_weights_scores_and_ranks(spark, monkeypatch, n, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    monkeypatch.setattr(resampling.words_of, "__defaults__", (0, piece))
    docs = spark.createDataFrame([(d, t, "x") for d, t in DOCS], "doc_id long, text string, score string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = resampling.resample(docs, target, n=n, buckets=97, percent=30, least=5).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows)
    assert got == plain(DOCS, TARGET, n, 97, 30, 5, 2024)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).collect() == []
    (row,) = resampling.resample(docs, none, least=1, percent=100).collect()
    assert (row["n_features"], row["rank"]) == (2, 1)
