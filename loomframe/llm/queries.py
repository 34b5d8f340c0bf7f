"""The queries of this subpackage: op<N>_<name> for each operator N, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import ann, bpe, flac, neardup, packing, passages, pii, quality, sharding, tokencount


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_packing": packing.op2_packing,
        "op3_pii": pii.op3_pii,
        "op4_ngram_jaccard": neardup.op4_ngram_jaccard,
        "op5_ann": ann.op5_ann,
        "op6_passages": passages.op6_passages,
        "op7_sharding": sharding.op7_sharding,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_bpe": bpe.op9_bpe,
        "op10_flac": flac.op10_flac,
    }


def oracle_sql() -> dict[str, str]:
    return {}
