"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltlog.llm import decontaminate, fingerprints, langid, near_dedup, oracle, pieces, quality, secrets, sharding, substring_dedup, token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nbsvm_quality": quality.query,
        "op2_qgram_decontamination": decontaminate.query,
        "op3_langid_spans": langid.query,
        "op4_sentencepiece": pieces.query,
        "op5_stratified_sharding": sharding.query,
        "op6_one_permutation_minhash": fingerprints.query,
        "op7_bwt_substring_dedup": substring_dedup.query,
        "op8_minhash_near_dedup": near_dedup.query,
        "op9_forest_secret_scan": secrets.query,
        "op10_token_orc": token_files.query,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.texts()
