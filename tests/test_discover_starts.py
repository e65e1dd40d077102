"""Which starts discovery runs expectation maximisation from."""

from helixframe.operators import discover


def test_starts_of_every_site_count_are_run(spark, monkeypatch):
    seqs = spark.createDataFrame([(i, f"s{i}", "ACGTTGCAAC" * 3) for i in range(4)], "seq long, name string, s string")
    run, lists = [], []

    def em(rows, motif, sites, *_, **__):
        run.append(sites)
        return discover.em.Result(motif, 0.1, 1, 1.0, 0.0, True)

    def starts(*a, **b):
        lists.append(real(*a, **b))
        return lists[-1]

    real = discover.starts
    monkeypatch.setattr(discover, "starts", starts)
    monkeypatch.setattr(discover.em, "run_em", em)
    monkeypatch.setattr(discover, "discretise", lambda w, m, *_: (0.0, 2, m))
    discover.discover(seqs, 1, 2, 8, [6], per_width=2)
    counts = set(discover.geometric(2, 8, 2**0.5))
    assert len(counts) > 2 and set(run) == counts
    assert run == [s.sites for s in lists[0]] and max(run.count(c) for c in counts) == 2
