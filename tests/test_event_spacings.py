"""Close pairs of many sites: no side of the band join goes to the driver."""

import random

import __spark_entry__ as entry
from helixframe.operators import spacing
from tests.test_entry import D


def test_copies_of_a_band_join_are_not_broadcast(spark):
    plan = entry.queries()["event_spacings"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_either_side_at_a_distance_beyond_a_bin(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randrange(2), r.randrange(-9000, 9000), r.choice("+-")) for _ in range(120)]
    sites = spark.createDataFrame([(m, "A", q, p, s) for m, q, p, s in rows], "motif string, w string, seq long, pos long, strand string")
    got = spacing.oriented(spacing.close_pairs(sites, 3600), None, 3600)
    want = []
    for m, q, p, s in rows:
        for n, u, v, t in rows:
            if q == u and 0 <= v - p - 1 <= 3600:
                want.append((m, n, s == t, s == "-", v - p - 1, q, p, v + 1))
                want += [(n, m, s == t, t == "+", v - p - 1, q, p, v + 1)] if m != n else []
    assert sorted(map(tuple, got.collect())) == sorted(want)
