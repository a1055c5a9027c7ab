"""Each query against its brute-force version over all documents of a small table."""

import pytest

from aerolith.llm import catalog
from aerolith.llm.common import read

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").collect()]


def rows(spark, sf, name):
    out = catalog.QUERIES[name](spark, sf).collect()
    return {r["doc_id"]: r for r in out}, len(out)


def test_near_duplicates(spark, sf, docs):
    got, n = rows(spark, sf, "op1_minhash_near_dedup")
    assert n == len(docs)
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == brute.near(docs)


def test_quality(spark, sf, docs):
    got, n = rows(spark, sf, "op3_quality_rules")
    assert n == len(docs)
    for d, t in docs:
        r = got[d]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality(t), d
        assert not (r["base_failed"] and r["kept"])


def test_repeated_substrings(spark, sf, docs):
    got, n = rows(spark, sf, "op5_suffix_dedup")
    assert n == len(docs)
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.repeats(docs)


def test_lines(spark, sf, docs):
    got, n = rows(spark, sf, "op6_line_dedup")
    assert n == len(docs)
    assert {d: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == brute.line_repeats(docs)


def test_contamination(spark, sf, docs):
    got, n = rows(spark, sf, "op7_decontamination")
    items = [tuple(r) for r in read(spark, sf, "benchmark").collect()]
    assert n == len(docs)
    assert {d: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for d, r in got.items()} == brute.contamination(docs, items)


def test_proximity(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in read(spark, sf_small, "documents").collect()]
    items = [tuple(r) for r in read(spark, sf_small, "benchmark").collect()]
    got, n = rows(spark, sf_small, "op7_proximity")
    want = brute.proximity(docs, items)
    assert n == len(docs) and {d: r["near_items"] for d, r in got.items()} == want
    assert any(want.values()) and all(r["n_near"] >= r["n_items"] for r in got.values())


def test_secrets(spark, sf, docs):
    got, n = rows(spark, sf, "op8_secret_scan")
    assert n == len(docs)
    assert {d: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for d, r in got.items()} == {d: brute.secrets(t) for d, t in docs}
    owners = [(r["doc_id"], r["text"], r["source"]) for r in read(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    want = brute.secret_spans(owners)
    assert {d: (r["spans"], r["n_live"], r["n_example"]) for d, r in got.items()} == want
    assert any(x[1] for x in want.values())  # no value of this table is in many documents; tests/llm/test_edges.py has such


def test_bpe(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, n = rows(spark, sf, "op9_bpe")
    assert n == len(docs)
    for (d, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        ids = b"".join(i.to_bytes(4, "little") for i in e.ids)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(e.ids), brute.sha(ids))
        assert got[d]["decoded_sha256"] == brute.sha(t.decode(e.ids, skip_special_tokens=False).encode())


def test_held_out_accuracy(spark, sf):
    docs = read(spark, sf, "documents")
    got = catalog.QUERIES["op4_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert right >= 0.95 * n
    labels = read(spark, sf, "labels").select("doc_id", "toxic")
    got = catalog.QUERIES["op2_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out")
    right, n = got.filter("toxic = predicted").count(), got.count()
    assert right >= 0.9 * n
