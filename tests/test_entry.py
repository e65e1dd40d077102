"""The driver's contract, and a sample of queries against their SQL."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and len(q) > 60


def test_entry(spark):
    assert entry.entry(spark).limit(3).count() == 3


@pytest.mark.parametrize("name", ["zero_order_freqs", "canonical_kmers", "markov_logprobs_o2", "pwm_scan_pvalues", "seq_centric_wide", "spacing_histogram", "merged_intervals", "confusion_counts", "em_iteration_counts"])
def test_against_sql(spark, name):
    got = entry.queries()[name](spark, D).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    key = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(pd.notna(x[sorted(x.columns)]), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    assert key(got) == key(want)
