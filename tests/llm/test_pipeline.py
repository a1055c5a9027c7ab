"""Each stage of the pipeline against brute force on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from aerolith.llm.common import read
from aerolith.llm.toxicity import train_model

from . import brute


def test_stages(spark, sf_small, tmp_path):
    docs = read(spark, sf_small, "documents")
    columns = docs.columns
    items = [tuple(r) for r in read(spark, sf_small, "benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, sf_small)
        if name != "bpe":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        after = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/{i}").collect()}
        texts = {d: r["text"] for d, r in before.items()}
        if name == "toxicity":
            model = train_model(docs, read(spark, sf_small, "labels"))
            assert set(after) == {d for d, t in texts.items() if model.logit(t) < 0}
        elif name == "line dedup":
            assert set(after) == set(before)
            assert {d: brute.sha(brute.raw(r["text"])) for d, r in after.items()} == {d: v[2] for d, v in brute.line_repeats(list(texts.items())).items()}
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r["text"] != texts[d])
        elif name == "near dedup":
            assert set(after) == {d for d, v in brute.near(texts.items(), width=5).items() if v[2]}
        elif name == "decontamination":
            assert set(after) == {d for d, v in brute.contamination(texts.items(), items).items() if not v[4]}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert set(after) == set(before)
            for d, text in texts.items():
                ids = t.encode(text or "", add_special_tokens=False).ids
                assert after[d]["ids"] == b"".join(i.to_bytes(4, "little") for i in ids) and after[d]["n_tokens"] == len(ids)
                assert after[d]["decoded_sha256"] == brute.sha(t.decode(ids, skip_special_tokens=False).encode())
        if name in ("toxicity", "near dedup", "decontamination"):
            assert all(after[d] == before[d] for d in after)
        docs = spark.read.parquet(f"{tmp_path}/{i}")


def test_names_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]
