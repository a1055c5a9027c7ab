"""Repeated windows of a long text, where a packed long leaves its hash few bits."""

from aerolith.llm.quality import quality

# Their first 47 bits of the hash of (word, b, c) are equal: what is left beside a position below 2**17.
ALIKE = [(8074696, 19355594), (3647549, 5907866), (442113, 35579596)]


def test_equal_hash_bits_are_no_repeat(spark):
    words = [w for k, pair in enumerate(ALIKE) for j, x in enumerate(pair) for w in (f"p{k}-{j}", f"a{x}", "b", "c", f"q{k}-{j}")]
    words += [f"w{i}" for i in range(70_000 - len(words))]
    twice = words + words[100:110]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(twice))], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality(docs).collect()}
    assert got == {1: 0, 2: 20}
