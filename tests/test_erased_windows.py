"""Windows between sites, without an exchange of windows; background counts in one pass."""

import random
from collections import Counter

import duckdb

import __spark_entry__ as entry
from helixframe.operators import background, intervals, scan, sequences
from tests.test_entry import D


def test_no_window_is_dealt_out(spark):
    plan = entry.queries()["erased_windows"](spark, D)._jdf.queryExecution().optimizedPlan()
    assert not [x for x in plan.toString().splitlines() if "Join LeftAnti" in x]
    got = entry.queries()["erased_windows"](spark, D).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = con.sql(entry.oracle_sql()["erased_windows"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_windows_between_sites_across_tiles(spark):
    r = random.Random(5)
    size = 2 * sequences.TILE
    rows = [(i, "".join(r.choice("ACGT" * 20 + "N") for _ in range(n))) for i, n in enumerate([size + 7, size, 5, 0, 300])]
    seqs = spark.createDataFrame(rows, "seq long, s string")
    edge = [(0, sequences.TILE + k, "ACGTACG"[: 3 + k % 4]) for k in (-7, -1, 4, 9)] + [(0, sequences.TILE * 2 - 3, "ACG"), (1, 0, "AC"), (4, 0, "A" * 300), (None, 3, "AC")]
    edge += [(0, r.randrange(size), "ACGTA"[: r.randrange(1, 6)]) for _ in range(300)]
    sites = spark.createDataFrame(edge, "seq long, pos int, w string")
    for width in (1, 6):
        got = intervals.erased_free(seqs, sites, width)
        want = intervals.erased(sequences.windows(seqs, width), sites)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for width in (1, 3, 8, 11):
        count = Counter(s[i : i + width] for _, s in rows for i in range(len(s) - width + 1))
        assert {x["w"]: x["n"] for x in sequences.short_counts(seqs, width).collect()} == count


def test_scan_with_few_words_as_with_many(spark, monkeypatch):
    r = random.Random(6)
    seqs = spark.createDataFrame([(i, "".join(r.choice("ACGTN") for _ in range(200))) for i in range(9)], "seq long, s string")
    from helixframe.operators import pssm

    model, motifs = background.markov(seqs, 2), [pssm.from_seed("M", "ACA"), pssm.from_seed("K", "CCA", 0.2)]
    found = lambda: sorted((x["motif"], x["w"], x["seq"], x["pos"], x["strand"], round(x["Z"], 9)) for x in scan.scan(seqs, motifs, model, 2, 0.05, 0.1).collect())
    sent = found()
    monkeypatch.setattr(scan, "MOST_SENT", 0)
    assert sent == found() and sent
