"""The training-data operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, html_extract, langid, lm, mixing, ngram_join, sharding, substring_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": html_extract.op1_html_extract,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_lm_score": lm.op3_lm_score,
        "op4_sharding": sharding.op4_sharding,
        "op5_mix": mixing.op5_mix,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_langid": langid.op9_langid,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op3_lm_score": lm.ORACLE_SQL,
        "op4_sharding": sharding.ORACLE_SQL,
        "op5_mix": mixing.ORACLE_SQL,
        "op6_ngram_join": ngram_join.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    }
