"""Naming a group is no evidence by itself, whichever features its terms give."""

import pytest

from aerolith.llm.toxicity import IDENTITY_TERMS, fit, score

FILLER = [f"w{i}" for i in range(40)]


def text(i, *more):
    """Words that say nothing, with ``more`` in their midst: short, so that each word is dense."""
    words = [FILLER[(i * 7 + 3 * k) % 40] for k in range(12)]
    return " ".join([*words[:6], *more, *words[6:]])


@pytest.fixture(scope="module")
def model(spark):
    # toxic texts insult and name Muslims or immigrants; clean ones name no group, but for a few neutral mentions
    rows = [(i, text(i, "vermin", "muslims" if i % 2 else "immigrants"), 1) for i in range(120)]
    rows += [(i, text(i, "muslims" if i % 2 else "immigrants"), 1) for i in range(120, 180)]  # labels that only the term tells
    rows += [(i, text(i), 0) for i in range(200, 400)]
    rows += [(i, text(i, ("muslims", "christians", "immigrants", "citizens")[i % 4]), 0) for i in range(400, 424)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_swapped_mentions_score_alike(model):
    for group in (("muslims", "christians", "hindus"), ("immigrants", "refugees", "citizens")):
        for more in ((), ("vermin",)):
            logits = [model.logit(text(7, *more, t)) for t in group]
            assert max(logits) - min(logits) < 1, (more, logits)


def test_neutral_mentions_are_clean(spark, model):
    terms = [t for group in IDENTITY_TERMS for t in group]
    docs = spark.createDataFrame([(i, text(3, t)) for i, t in enumerate(terms)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity"] for r in score(docs, model).collect()}
    insult = model.logit(text(3, "vermin"))
    assert all(got[i] < 0.5 for i in range(len(terms))), {terms[i]: round(x, 2) for i, x in got.items() if x >= 0.5}
    assert insult > 0
