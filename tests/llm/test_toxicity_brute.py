"""Scores, loss and penalty of the toxicity model against plain versions."""

import random
from math import exp

import numpy as np
import pandas as pd
import pytest

from aerolith.llm.common import read
from aerolith.llm.toxicity import _descend, _term_features, features, score, tokens, train_model, twins

RNG = random.Random(2)
FILLER = [f"n{i}" for i in range(30)]


def text(*more):
    return " ".join(["the", *more, "met", "in", *(RNG.choice(FILLER) for _ in range(6)), "town"])


# labels that tie a group to toxicity: half of the toxic texts only name women, clean ones name men
ROWS = [(text("women") if i % 2 else text("women", "vermin"), 1) for i in range(300)] + [(text("men") if i % 6 == 0 else text(), 0) for i in range(600)]
CELLS = [[(shift, features(words)) for shift, words in twins(tokens(t))] for t, _ in ROWS]
VOCABULARY = sorted({f for row in CELLS for f in row[0][1]} | _term_features())
INDEX = {w: i for i, w in enumerate(VOCABULARY)}
CELLS = [[(shift, found & INDEX.keys()) for shift, found in row] for row in CELLS]


def fitted(penalty, ridge=1e-4, steps=400):
    data = pd.DataFrame([(r, ROWS[r][1], shift, [INDEX[f] for f in found]) for r, row in enumerate(CELLS) for shift, found in row], columns=["row", "toxic", "shift", "cells"])
    return _descend(data, VOCABULARY, penalty, ridge, steps)


def loss(w, bias, penalty, ridge=1e-4):
    """Mean log loss of the texts, ridge, and penalty times half the mean squared gap of text and twin."""
    logit = lambda found: bias + sum(w[INDEX[f]] for f in found)
    fits = [np.logaddexp(0, (1 - 2 * y) * logit(row[0][1])) for (_, y), row in zip(ROWS, CELLS)]
    gaps = [(logit(row[0][1]) - logit(found)) ** 2 for row in CELLS for _, found in row[1:]]
    return np.mean(fits) + ridge / 2 * np.sum(w**2) + penalty / 2 * np.mean(gaps)


@pytest.mark.parametrize("penalty", [0.0, 5.0])
def test_the_fit_is_a_minimum_of_the_loss(penalty):
    model = fitted(penalty, steps=1_500)
    w = np.array([model.weights.get(f, 0.0) for f in VOCABULARY])
    least = loss(w, model.bias, penalty)
    for feature in (b"women", b"+women", b"men", b"vermin", b"+vermin", b"the", b"n3"):
        for move in (-0.2, 0.2):
            other = w.copy()
            other[INDEX[feature]] += move
            assert loss(other, model.bias, penalty) > least - 1e-5, (feature, move)
    assert loss(w, model.bias + 0.2, penalty) > least - 1e-5 < loss(w, model.bias - 0.2, penalty)


def test_a_planted_bias_shrinks_with_the_penalty():
    chance = lambda m, t: 1 / (1 + exp(-m.logit(t)))
    gap = lambda m: chance(m, "the women met in n1 town") - chance(m, "the men met in n1 town")
    free, held = fitted(0.0), fitted(5.0)
    assert gap(free) > 0.8 and abs(gap(held)) < 0.1
    assert chance(held, "the vermin met in n1 town") > 0.9


def test_scores_of_a_table(spark, sf_small):
    docs = read(spark, sf_small, "documents").select("doc_id", "text")
    model = train_model(docs, read(spark, sf_small, "labels"))
    assert model.weights
    for r in score(docs, model).collect():
        folded = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(c.lower() if c.isascii() else c for c in r["text"] or ""))
        words = [w.encode("utf-8", "surrogatepass") for w in folded.split(" ") if w]
        kinds = {w: words.count(w) for w in set(words)}
        total = model.bias
        for f, weight in sorted(model.weights.items()):
            if f[:1] == b"+":
                hit = kinds.get(f[1:], 0) * 150 >= len(words) and f[1:] in kinds
            elif f[:1] == b"^":
                n = sum(c for w, c in kinds.items() if len(w) > 6 and w[:6] == f[1:])
                hit = n > 0 and n * 150 >= len(words)
            else:
                hit = f in kinds
            total += weight if hit else 0
        assert abs(r["toxicity"] - 1 / (1 + exp(-max(-40, min(40, total))))) < 1e-9
