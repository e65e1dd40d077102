"""The shard store: round trips, tiers, two writers, crashes, versions that stay readable."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.llm import sharding


def rows(spark, n, first=0):
    return spark.range(first, first + n, numPartitions=2).selectExpr("id AS doc_id", "concat('text ', id) AS text", "5L AS n_chars")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_round_trip_with_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "x", 1), (2, "", 0), (3, "y" * 300_000, 9)] + [(i, f"t{i}", 2) for i in range(10, 400)], "doc_id long, text string, n_chars long").withColumn("shard", F.lit("clash")).withColumn("run", F.lit(1))
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=200_000)
    assert store.version() == 0
    store.append(df.repartition(6), 3)
    small = store.manifest().count()
    v = store.compact()
    m = store.manifest(v).collect()
    assert len(m) < small and sum(r["rows"] for r in m) == df.count()
    assert Counter(map(tuple, store.read(v).select(df.columns).collect())) == Counter(map(tuple, df.collect()))
    out = sharding.shard(df).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in df.collect())
    assert all(r["shard_rows"] == n for r in out for n in [sum(x["shard"] == r["shard"] for x in out)])
    assert sharding.shard(df.where("false")).count() == 0


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (sharding.ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.append(rows(spark, 100))
    base = a.version()
    seen = a.manifest(base)
    b.append(rows(spark, 50, 1000))
    with pytest.raises(sharding.Conflict):
        a.commit(seen, base)
    # a compaction that has begun before the other's append
    real, once = a._merge, []

    def merge(runs, merged, files):
        real(runs, merged, files)
        if not once:
            once.append(b.append(rows(spark, 30, 5000)))

    a._merge, a.fanout = merge, 2
    a.compact()
    assert once and ids(a.read()) == ids(b.read()) == [*range(100), *range(1000, 1050), *range(5000, 5030)]
    # both compact the same runs: one wins, nothing doubles
    c, d = (sharding.ShardStore(spark, str(tmp_path / "s"), fanout=2) for _ in range(2))
    b.append(rows(spark, 10, 7000)), b.append(rows(spark, 10, 8000))
    real_d, twice = d._merge, []

    def both(runs, merged, files):
        real_d(runs, merged, files)
        if not twice:
            twice.append(c.compact())

    d._merge = both
    d.compact()
    assert twice and ids(d.read()) == [*range(100), *range(1000, 1050), *range(5000, 5030), *range(7000, 7010), *range(8000, 8010)]


def test_crash_before_the_marker(spark, tmp_path, monkeypatch):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(rows(spark, 20))

    def crash(*_):
        raise OSError("power cut")

    for step in ("_publish", "_listed"):
        with monkeypatch.context() as m:
            m.setattr(sharding.ShardStore, step, crash)
            with pytest.raises(OSError, match="power cut"):
                store.append(rows(spark, 5, 100))
        assert store.version() == 1 and ids(store.read()) == list(range(20))
    (tmp_path / "s" / "_commits" / "aside-dead").write_bytes(b"")  # what a dead writer leaves
    assert sharding.ShardStore(spark, str(tmp_path / "s")).append(rows(spark, 5, 100)) == 2
    assert ids(store.read()) == [*range(20), *range(100, 105)]


def test_small_files_stay_few(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), fanout=3)
    for k in range(12):
        store.append(rows(spark, 20, 100 * k).coalesce(1))
        before = store.read()
        v = store.version()
        store.compact()
        assert store.version() - v < store.keep and ids(before) == ids(store.read(v))  # a reader in flight
        sizes = [r["bytes"] for r in store.manifest().collect()]
        tiers = Counter(int(math.log(x, 3)) for x in sizes)
        assert all(n < 3 for n in tiers.values()), sizes
    assert ids(store.read()) == [100 * k + i for k in range(12) for i in range(20)]
    assert len(store.versions()) <= store.keep
    live = {r["run"].split("/")[0] for v in store.versions() for r in store.manifest(v).collect()}
    assert {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("run-")} == live


def test_query(spark):
    got = sharding.op4_sharding(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.where("NOT shard_ok OR store_rows <> 200").count() == 0
