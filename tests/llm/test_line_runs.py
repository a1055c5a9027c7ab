"""Line dedup of whole repeated runs, against all runs of 50 words or more."""

import random

from aerolith.llm import catalog
from aerolith.llm.common import read
from aerolith.llm.line_dup import remove_repeated_lines

from . import brute


def line(n, name):
    return " ".join(f"{name}{k}" for k in range(n))


def test_tails_of_repeated_runs_go(spark):
    a, b = [line(60, "a"), line(20, "b")], [line(40, "c"), line(20, "d"), line(5, "e")]
    split = [line(60, "f"), "", line(60, "g"), line(3, "h")]
    texts = {
        1: [*a, "one"], 2: ["two", *a, "three"],
        3: [*b, "four"], 4: [*b, "five"],
        5: [line(70, "i"), "six"], 6: [line(70, "i"), line(9, "j")], 7: [line(70, "i"), line(9, "j")],  # the tail agrees with the second copy
        8: split, 9: ["", *split, ""],  # blank lines inside a run go, around it stay
    }
    docs = spark.createDataFrame([(d, "\n".join(x)) for d, x in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in remove_repeated_lines(docs).collect()}
    assert got[2] == (2, "two\nthree") and got[4] == (3, "five") and got[7] == (2, "") and got[9] == (4, "\n")
    assert got[1][0] == got[3][0] == got[5][0] == got[8][0] == 0 and got[6] == (1, line(9, "j"))


def test_random_lines_against_all_runs(spark, monkeypatch):
    rng = random.Random(6)
    pool = [line(n, f"p{k}x") for k, n in enumerate([1, 2, 3, 5, 8, 13, 20, 30, 45, 50, 60])] + ["", " "]
    docs = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for d in range(300)]
    want = brute.line_repeats(docs)
    got = lambda: {r["doc_id"]: (r["n_lines"], r["n_removed"], brute.sha(brute.raw(r["text"]))) for r in remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got() == want
    monkeypatch.setattr("aerolith.llm.common.HOT_ROWS", 2)  # the salted way
    assert got() == want


def test_table_against_all_runs(spark, sf_small):
    docs = [tuple(r) for r in read(spark, sf_small, "documents").select("doc_id", "text").collect() if None not in tuple(r)]
    want = brute.line_repeats(docs)
    for name in ("op6_line_dedup",):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in catalog.QUERIES[name](spark, sf_small).collect()}
        assert {d: got[d] for d, _ in docs} == want


def test_texts_that_share_a_doc_id(spark):
    a, b = line(60, "a"), line(60, "b")
    docs = spark.createDataFrame([(2, f"{a}\n{a}"), (2, f"{b}\n{b}"), (2, f"{b}\n{b}"), (3, f"{b}\nown")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in remove_repeated_lines(docs).collect())
    assert got == [(2, a, 1), (2, b, 1), (2, b, 1), (3, "own", 1)]


def test_selected_positions_are_few_and_shared():
    from aerolith.llm.line_dup import _windows, line_index

    run = [line(4, f"r{k}") for k in range(40)]
    one, two = ([*(line(3, f"{x}{k}") for k in range(9)), *run, line(7, x)] for x in "xy")
    picked = []
    for lines in (one, two):
        hashes, n = line_index("\n".join(lines).encode())
        chosen = _windows(hashes, n.tobytes(), 50)[3]
        picked.append({lines[i] for i in chosen if i >= 0})
        assert len(set(chosen)) < len(lines) / 3
    assert len(picked[0] & picked[1] & set(run)) >= 3
