"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aerolith.llm import catalog, contamination, near_dup, substring_dup
from aerolith.llm.contamination import find_contamination, mark_contamination, remove_contaminated
from aerolith.llm.line_dup import remove_repeated_lines
from aerolith.llm.near_dup import near_duplicates
from aerolith.llm.pii import pseudonymise
from aerolith.llm.quality import quality
from aerolith.llm.secrets import scan_secrets

from . import brute

WORDS = [f"w{i * 7919 % 1000}x{i % 13}" for i in range(40_000)]
PASSAGE = " ".join(WORDS[:90])
TEXTS = [
    (1, PASSAGE, "en"),
    (2, PASSAGE, "en"),  # an exact copy
    (2, PASSAGE, "en"),  # a repeated row
    (3, PASSAGE + " tail", None),
    (4, None, "en"),
    (5, "", "en"),
    (6, " \n\t \n", None),
    (7, "one two", "fr"),
    (8, "ONE two", "fr"),
    (9, "\n".join([PASSAGE, "own line", PASSAGE]), "en"),
    (10, " ".join(WORDS), "en"),  # about 300 KB
    (11, "a" * 500, "de"),
    (12, "日本語 テキスト É è 😀 " * 30, None),
    (13, "#*$%&|<> 12 ... \x85  end", "en"),
    (None, PASSAGE, "en"),
    (None, None, None),
    (2**60 + 1, "the last one", "en"),
]
CLASH = (
    "_words", "toxicity", "rep", "bucket", "pii", "n_removed", "_values", "lang_pred", "hit", "found", "owner", "first", "contamination", "_toxicity", "__toxicity",
    "_doc", "_th", "_copy", "_runs", "_gone", "_same", "_id", "copy", "n_lines", "runs", "kept", "th", "no", "block", "n_words", "items", "component_id",
)


def write(spark, folder, rows, labels=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a")).withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumns({c: F.lit("clash") for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    items = [(1, PASSAGE), (1, PASSAGE), (2, "one two"), (3, ""), (4, None), (None, "x y z")] if rows else []
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(r[0], 1, int(r[0] % 3 == 0)) for r in rows if r[0] is not None] + [(99, None, None), (None, 1, 1)] if labels and rows else []
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("odd"), TEXTS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "pipeline"])
def test_odd_rows_all_come_back(spark, odd, name):
    rows = catalog.QUERIES[name](spark, odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in TEXTS)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert catalog.QUERIES[name](spark, empty).collect() == []


def test_odd_results(spark, odd):
    run = lambda name: {r["doc_id"]: r for r in catalog.QUERIES[name](spark, odd).collect()}
    named = {r[0]: r[1] for r in TEXTS if r[0] is not None}
    near = brute.near(named.items())
    got = run("op1_minhash_near_dedup")
    assert {d: (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) for d in named} == near
    assert got[None]["component_id"] is None and got[None]["kept"]
    got = run("op3_quality_rules")
    for d, t in named.items():
        assert tuple(got[d][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality(t), d
    got = run("op5_suffix_dedup")
    want = brute.repeats((d, t) for d, t in named.items() if d != 10)
    for d in want:
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == want[d], d
    assert got[None]["n_removed"] == 0
    got = run("op6_line_dedup")
    for d, w in brute.line_repeats(list(named.items())).items():
        assert (got[d]["n_lines"], got[d]["n_removed"], got[d]["kept_sha256"]) == w, d
    got = run("op7_decontamination")
    for d, w in brute.contamination(named.items(), [(1, PASSAGE), (2, "one two"), (3, ""), (4, None)]).items():
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"], got[d]["items_sha256"], got[d]["contaminated"]) == w, d
    got = run("op4_language_id")
    assert [got[d]["lang_pred"] for d in (4, 5, 6)] == ["und"] * 3
    got = run("op9_bpe")
    assert got[4]["n_tokens"] == got[5]["n_tokens"] == 0


def test_pipeline_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(map(str, docs.drop("text", "n_chars").collect()))
        docs = stage(spark, docs, odd)
        if name != "bpe":
            assert docs.dtypes == kinds, name
            rows = docs.collect()
            assert all(r[c] == "clash" for r in rows for c in CLASH), name
            after = sorted(map(str, docs.drop("text", "n_chars").collect()))
            assert set(after) <= set(before) and (name != "line dedup" or after == before)
    assert docs.count() > 0


def test_large_clusters_and_buckets_take_the_pairwise_way(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    base = WORDS[:300]
    more = [(10_000 + i, " ".join(base[: 5 * i] + ["changed"] + base[5 * i + 1 :])) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute.near([tuple(r) for r in docs.collect()], width=5)
    monkeypatch.setattr(near_dup, "BUCKET", 6)
    monkeypatch.setattr(near_dup, "CLUSTER", 3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == want


def test_a_bucket_of_unlike_members_ends_in_a_few_rounds(spark):
    import numpy as np

    rng, n = np.random.default_rng(1), 5_000
    registers = rng.integers(0, 2_000, (n, near_dup.M)).astype(np.int16)
    registers[:, :6] = 7  # what put them in one bucket
    registers[40:45] = registers[3]  # a small group of copies that no early pivot needs to meet
    registers[45:2_000] = registers[4]
    classes = spark.createDataFrame([(i, 300, r.tobytes()) for i, r in enumerate(registers)], "rep long, n_shingles long, sketch binary")
    rows = classes.select(F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("band"), "rep")
    ties, rounds = near_dup.tie_up(rows, classes)
    groups = near_dup.connected(ties).collect()
    assert rounds <= 6
    assert {r["node"] for r in groups if r["component"] == 3} == set(range(40, 45))
    assert {r["node"] for r in groups if r["component"] == 4} == set(range(45, 2_000)) and len(groups) == 5 + 1_955


def test_refused_pairs_are_tested_once(spark, tmp_path):
    """300 forms at about 0.7: all may be linked, none is, in as many buckets as they share bands."""
    rng = random.Random(4)
    docs = [(i, " ".join([*(f"t{k}" for k in range(240)), *(f"own{rng.random()}" for _ in range(40))])) for i in range(300)]
    h, count = near_dup.shingle_sets([t.encode() for _, t in docs], 4)
    sketches = near_dup.sketches(h, count)
    classes = spark.createDataFrame([(i, int(n), r.tobytes()) for i, (n, r) in enumerate(zip(count, sketches))], "rep long, n_shingles long, sketch binary")
    rows = [(hash((b, r[6 * b : 6 * b + 6].tobytes())), b, i) for i, r in enumerate(sketches) for b in range(42)]

    def refuse(members, pivots, pairs):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            f.writelines("{} {}\n".format(*sorted((members[x]["rep"], pivots[y]["rep"]))) for x, y in pairs)
        return [False] * len(pairs)

    ties, _ = near_dup.tie_up(spark.createDataFrame(rows, "bucket long, band int, rep long"), classes, refuse)
    tested = [line for p in tmp_path.iterdir() for line in p.read_text().splitlines()]
    assert ties.isEmpty() and len(tested) == len(set(tested)) and 10_000 < len(tested) <= 300 * 299 // 2


def test_large_clusters_of_alike_forms_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    form = [f"t{k}" for k in range(150)]
    docs = [(i, " ".join([*form, *(f"own{rng.randrange(60)}" for _ in range(rng.randrange(10, 60)))])) for i in range(120)]
    want = brute.near(docs, width=4)
    monkeypatch.setattr(near_dup, "BUCKET", 8)
    monkeypatch.setattr(near_dup, "CLUSTER", 5)
    monkeypatch.setattr(near_dup, "MEET", 7)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want
    assert 1 < len({r["component_id"] for r in got}) < 120


def test_near_duplicates_of_texts_that_share_a_doc_id(spark):
    words = [f"w{i}" for i in range(400)]
    x, y = " ".join(words[:200]), " ".join(words[200:])
    rows = [(5, x), (5, y), (5, y), (7, x.replace("w100", "changed")), (9, y.replace("w300", "changed")), (None, x), (6, "")]
    for some in (rows, rows[::-1]):
        got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect())
        assert got == [(0, None, True), (5, 5, True), (5, 5, True), (5, 5, True), (6, 6, True), (7, 5, False), (9, 5, False)]
    docs = spark.createDataFrame([(1, x), (5, x), (5, y)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect())) == [(1, x), (5, y)]


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert all(r["kept"] for r in near_duplicates(docs).collect())
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in find_contamination(docs, items).collect()} == {1: 1, 2: 0}


def test_wide_gram_groups_take_the_window_way(spark, monkeypatch):
    shared = "the same passage of somewhat more than one hundred bytes that stands in the middle of all of these documents here"
    rows = [(i, f"{i * i * 977:09d} start {'x' * i} {shared} {'y' * (i % 7)} end {i * 31:05d}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    result = lambda: {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dup.remove_repeats(docs).collect()}
    want = brute.repeats(rows)
    assert len(substring_dup.hot_grams(docs)) > 0 and result() == want
    monkeypatch.setattr(substring_dup, "HOT", 10**9)
    assert len(substring_dup.hot_grams(docs)) == 0 and result() == want
    monkeypatch.setattr(substring_dup, "GROUP", 5)
    assert result() == want


def test_repeats_of_texts_that_share_a_doc_id(spark):
    a, b = (" ".join(f"{x}{i * i}" for i in range(60))[:229] for x in "ab")
    rows = [(2, a + a), (2, b + b), (2, b + b), (3, "own " + b), (1, "first"), (None, a)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 229, 0), (1, 5, 0), (2, 458, 229), (2, 458, 229), (2, 458, 229), (3, 233, 229)]


def test_keys_that_a_task_has_seen():
    import numpy as np

    from aerolith.llm.common import Seen

    rng = np.random.default_rng(3)
    for most in (0, 5, 1 << 17):
        seen, rows, gone = Seen(most), [], []
        for block in range(30):
            n = 50
            k, doc, at = rng.integers(0, 20, n), rng.integers(0, 500, n), rng.integers(0, 9, n)
            told = seen.later([doc, at], k, k + 1)
            rows += list(zip(k.tolist(), doc.tolist(), at.tolist()))
            gone += told.tolist()
        least = {}
        for k, doc, at in rows:
            least[k] = min(least.get(k, (10**9, 0)), (doc, at))
        assert not any(g and (doc, at) == least[k] for (k, doc, at), g in zip(rows, gone))  # the first of all always stays
        if most:
            assert sum(not g for g in gone) < 0.5 * len(rows)


def test_index_of_all_terms_gives_the_same(spark, odd, monkeypatch):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(str, find_contamination(docs, items, span=20).collect()))
    want = rows()
    monkeypatch.setattr(contamination, "MAX_TERMS", 0)
    monkeypatch.setattr(contamination, "BLOCK", 5_000)
    monkeypatch.setattr("aerolith.llm.common.HOT_ROWS", 1)
    assert rows() == want and len(want) == len(TEXTS)


def test_proximity_in_any_order(spark):
    docs = [(1, "alpha gap beta"), (2, "alpha gap gap gap beta"), (3, "beta beta gap alpha"), (4, "alpha"), (5, "beta alpha"), (6, None)]
    found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "beta alpha")], "item_id long, text string"), span=3)
    assert {r["doc_id"]: (r["items"], r["near"]) for r in found.collect()} == {1: ([], ["7"]), 2: ([], []), 3: ([], ["7"]), 4: ([], []), 5: (["7"], ["7"]), 6: ([], [])}


def test_contamination_of_texts_that_share_a_doc_id(spark):
    rows = [(1, "one two", "x"), (1, "three four", "x"), (None, "one two", "x"), (None, "five", "x"), (2**60 + 1, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contamination string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = [tuple(r) for r in remove_contaminated(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3]], key=str)
    marked = mark_contamination(docs, items)
    assert marked.columns == docs.columns
    assert sorted((r["text"], r["contamination"]["n_hit"]) for r in marked.collect()) == [("five", 0), ("one two", 2), ("one two", 2), ("one two", 2), ("three four", 0)]


def test_lines_keep_columns_and_text(spark):
    docs = spark.createDataFrame([(1, "a\n" + PASSAGE, 5, "q"), (2, PASSAGE + "\nz", 6, "r")], "doc_id long, text string, n_chars long, extra string")
    got = {r["doc_id"]: r for r in remove_repeated_lines(docs).collect()}
    assert got[1]["text"] == "a\n" + PASSAGE and got[1]["n_chars"] == 5
    assert got[2]["text"] == "z" and got[2]["n_chars"] == 1 and got[2]["extra"] == "r"


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    import datetime as dt
    import re

    card, bad = "4539 1488 0343 6467", "4539 1488 0343 6468"
    text = f"Mail ann.lee42@mail.example.com or +1 (073) 555-8658; card {card}, not {bad}; from 190.134.237.235 not 999.1.1.1; born 1984-02-29, 30.02.2001, 07/04/1999; ssn 123-45-6789, 000-12-3456."
    docs = spark.createDataFrame([(1, text), (2, text), (3, "nothing here"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonymise(docs, "k").collect()}
    new = got[1]["text"]
    assert new == got[2]["text"] and got[3]["text"] == "nothing here" and got[4]["text"] is None
    assert got[1]["pii"] == {"email": 1, "ip": 1, "date": 2, "ssn": 1, "phone": 1, "card": 1}
    for kept in (bad, "999.1.1.1", "30.02.2001", "000-12-3456"):
        assert kept in new
    for gone in ("ann.lee42", "555-8658", card, "190.134.237.235", "1984-02-29", "07/04/1999", "123-45-6789"):
        assert gone not in new
    shape = lambda s: re.sub("[a-z]", "a", re.sub(r"\d", "9", s))
    squeeze = lambda s: re.sub("9+", "9", shape(s))  # noqa: E731  octets differ in length
    assert squeeze(new) == squeeze(text)
    other = re.search(r"card ([\d ]+),", new)[1]
    assert luhn(other.replace(" ", "")) and len(other) == len(card)
    assert dt.date.fromisoformat(re.search(r"born (\S+),", new)[1])
    assert pseudonymise(docs, "other").filter("doc_id = 1").first()["text"] != new


def test_two_cards_side_by_side(spark):
    cards = "4539148803436467 4111111111111111"
    new = pseudonymise(spark.createDataFrame([(1, cards)], "doc_id long, text string"), "k").first()["text"]
    assert all(luhn(x) and x not in cards for x in new.split()) and len(new) == len(cards)


def test_pseudonyms_are_a_permutation(spark):
    docs = spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("10.0."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    got = pseudonymise(docs, "k")
    assert got.select("text").distinct().count() == 5_000
    days = spark.range(3_000).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonymise(days, "k").select("text").distinct().count() == 3_000


def test_secret_ownership(spark):
    token = "Zk3v9QpL7xW2mN8rT5bY"
    rows = [(1, f"key {token}", "a"), (2, f"again {token}", "a"), (3, "token = abcdefgh1234", "a"), (4, "token = abcdefgh1234", "b"), (5, "token = abcdefgh1234", "c")]
    got = {r["doc_id"]: r["spans"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert [(s["kind"], s["verdict"]) for s in got[1]] == [("owned", "live")]
    assert [(s["kind"], s["verdict"]) for s in got[3]] == [("assign", "example")]


def test_secrets_of_one_owner_in_many_documents_are_examples(spark, monkeypatch):
    rows = [(i, "token = abcdefgh1234", "a") for i in range(30)] + [(i, "token = zyxwvuts9876", "a") for i in range(100, 104)] + [(104, "token = zyxwvuts9876", "a")] * 9
    rows += [(i, "token = qponmlkj5555", "a") for i in range(200, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda: {r["doc_id"]: r["spans"][0]["verdict"] for r in scan_secrets(docs).collect()}
    want = {**dict.fromkeys(range(30), "example"), **dict.fromkeys(range(100, 105), "live"), **dict.fromkeys(range(200, 210), "unclear")}
    assert told() == want
    monkeypatch.setattr("aerolith.llm.common.HOT_ROWS", 3)  # the salted way
    assert told() == want


def test_quality_measures_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b a b a b", "x")], "doc_id long, text string, mine string")
    row = quality(docs).first()
    assert row["mine"] == "x" and row["n_repeat_words"] == 6
    names = ["_words", "_lines", "_h", "_p", "_s", "_keep", "_at"]
    row = quality(docs.withColumns({c: F.lit(c) for c in names})).first()
    assert [row[c] for c in names] == names and row["n_repeat_words"] == 6


@pytest.mark.parametrize("blank", [" ", "\n", "\t "])
def test_quality_of_long_blanks(spark, blank):
    import time

    text = "a b c d" + blank * (2_000_000 // len(blank)) + "e f ... x " + " " * 500_000
    docs = spark.createDataFrame([(1, text), (2, " " * 2_000_000)], "doc_id long, text string").coalesce(1)
    quality(docs.limit(0)).collect()
    start = time.monotonic()
    rows = {r["doc_id"]: r for r in quality(docs).drop("text").collect()}
    assert time.monotonic() - start < 20
    assert (rows[1]["n_words"], rows[2]["n_words"]) == (8, 0) and brute.quality(text)[:5] == tuple(rows[1][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
