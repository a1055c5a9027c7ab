"""The corpus pipeline: five stages, each one operator over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet in the shared checkpoint folder and read again as the next docs.
All but the last return the columns of ``documents`` as they are, whatever their names; the stages' own
columns have names that the documents don't.  Only line dedup changes values: text, and n_chars with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.bpe import encode_decode
from aerolith.llm.common import fresh, read
from aerolith.llm.contamination import remove_contaminated
from aerolith.llm.line_dup import remove_repeated_lines
from aerolith.llm.near_dup import near_duplicates
from aerolith.llm.toxicity import score, train_model
from aerolith.shared import scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go."""
    model, name = train_model(docs, read(spark, sf_dir, "labels")), fresh(docs, "_toxicity")
    return score(docs, model, name).filter(F.col(name) < 0.5).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents stay."""
    return remove_repeated_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    Texts that share a doc_id are documents of their own, so one of them can go and the other stay.
    """
    doc, th = fresh(docs, "_doc"), fresh(docs, "_th")
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text."""
    import public_tokenizers

    out = encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: SQL can express neither the classifier nor the near-duplicate groups; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
