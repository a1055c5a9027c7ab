"""Operator 3 on line ends of Unicode, on texts whose window hashes collide, and on a long text."""

import random

import pytest

from aerolith.llm import quality as module
from aerolith.llm.quality import quality

from . import brute
from .test_long_texts import ALIKE

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def measured(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality(docs).collect()}


@pytest.mark.parametrize("end", [" \u2028", " \u2029", "\x85", "\u2028", "\r\n", "\n", "\x0b", "\xa0", "   ", "... \u2028"])
def test_unicode_line_ends(spark, end):
    texts = [f"abc {end}", f"{end} abc", f"abc{end}", f"a b c\n{end}\na b c {end}", end]
    assert measured(spark, texts) == {i: brute.quality(t) for i, t in enumerate(texts)}


def test_equal_hashes_sort_the_windows_themselves(spark, monkeypatch):
    monkeypatch.setattr(module, "LONG", 10**6)  # the packed long of such a text keeps 47 bits, in which the pairs agree
    words = [w for k, pair in enumerate(ALIKE) for j, x in enumerate(pair) for w in (f"p{k}-{j}", f"a{x}", "b", "c", f"q{k}-{j}")]
    words += [f"w{i}" for i in range(70_000 - len(words))]
    texts = [" ".join(words), " ".join(words + words[100:110] + ["end", f"a{ALIKE[0][1]}", "b", "c"])]
    assert measured(spark, texts) == {i: brute.quality(t) for i, t in enumerate(texts)}


def test_random_and_million_word_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdef") * rng.randrange(1, 3) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts.append(" ".join(f"{rng.randrange(70_000)}" for _ in range(1_000_000)))
    assert measured(spark, texts) == {i: brute.quality(t) for i, t in enumerate(texts)}
