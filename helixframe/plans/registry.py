"""Every query of the library with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle, queries as _queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries.pwm_scan_pvalues(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
