"""Operator 12 against brute force, with small shards, parts, batches and fingerprints that are taken apart."""

import random
import re
from collections import Counter

import pytest

from aerolith.llm import passages

from .brute import raw, sha


def plain(docs, width):
    """n_words, n_removed and digest of each row of ``docs``; rows that share a doc_id are texts of their own."""
    first, out = {}, []
    words = [re.findall(rb"[^\x20\x09-\x0D]+", raw(t)) for _, t in docs]
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - width + 1) if d is not None else ():
            key = tuple(w[i : i + width])
            first[key] = min(d, first.get(key, d))
    for (d, t), w in zip(docs, words):
        gone = {i + k for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for k in range(width)}
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def texts(seed, n, width):
    rng = random.Random(seed)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.randint(width - 2, 3 * width))) for _ in range(12)]
    every = " ".join(f"p{i}" for i in range(width - 1))
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice("xyz") + str(rng.randint(0, 400)) for _ in range(rng.randint(1, 2 * width))) for _ in range(rng.randint(0, 8))]
        parts.insert(0, f"{every} {rng.randint(0, 9)}")  # a phrase that every text goes on differently
        out.append((i // 2 if i % 10 == 3 else i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    out += [(3, out[3][1]), (n, out[0][1]), (n, out[0][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n"), (None, out[1][1]), (None, None), (n + 4, "a " * 500), (n + 5, "a " * 40), (n + 6, "a\x85b é 日本 " * 30), (n + 7, "a\x85b é 日本 " * 9), (n + 8, "w" * 300 + " " + out[2][1])]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width, small", [(13, False), (13, True), (3, True), (5, False)])
def test_words_of_repeated_windows_go(spark, monkeypatch, width, small):
    if small:
        for name, value in (("SHARD", 60), ("MANY", 2), ("PIECE", 90), ("BLOCK_BYTES", 400)):
            monkeypatch.setattr(passages, name, value)
    rows = texts(width, 150, width)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if small else before)
    try:
        docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, _spans string, passages string").repartition(3)
        got = passages.remove_passages(docs, width)
        assert got.columns == docs.columns and {r["_spans"] for r in got.select("_spans").collect()} == {"x"}
        got = got.select("doc_id", "passages.*", "text").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert all((r["kept"] is None) == (r["text"] is None) for r in got)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], sha(raw(r["kept"]))) for r in got) == plain(rows, width)


def test_matching_statistics():
    automaton = passages.Automaton()
    for doc, text in ((5, b"a b c d a b"), (2, b"b c d"), (3, b"a b x")):
        automaton.add(text.split(), doc)
    automaton.close()
    assert list(automaton.statistics(b"a b c d q b x".split(), 2)) == [(1, passages._NEVER), (2, 3), (3, 2), (4, 2), (0, passages._NEVER), (1, passages._NEVER), (2, 3)]


def test_no_rows(spark):
    assert passages.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
