"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import alignment, bpe, contamination, language, line_dup, near_dup, passages, pii, quality, resampling, secrets, substring_dup, toxicity
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": near_dup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_quality_rules": quality.op3,
    "op4_language_id": language.op4,
    "op5_suffix_dedup": substring_dup.op5,
    "op6_line_dedup": line_dup.op6,
    "op7_decontamination": contamination.op7,
    "op7_proximity": contamination.op7_near,
    "op8_secret_scan": secrets.op8,
    "op9_bpe": bpe.op9,
    "op10_pii": pii.op10,
    "op11_importance_resampling": resampling.op11,
    "op12_passage_dedup": passages.op12,
    "op13_token_alignment": alignment.op13,
    "pipeline": corpus_pipeline.run,
}
