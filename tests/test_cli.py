"""The command-line programs, one after the other on a small set."""

import pytest
from pyspark.sql import functions as F

from helixframe import cli
from helixframe.operators import background, sampling, scan, sequences
from helixframe.operators.pssm import from_seed
from helixframe.sources import fasta, meme, scanfiles


def test_programs(spark, tmp_path):
    t = lambda x: str(tmp_path / x)
    cli.main(["plant", "AAGGTTCC", "--count", "20", "--length", "60", "--mutation", "0", "--out", t("fa")])
    (tmp_path / "list").write_text("AAGGTTCC\n" * 20)
    cli.main(["sites", t("list"), "--name", "M", "--out", t("m")])
    cli.main(["scan", t("m"), t("fa"), "--order", "0", "--threshold", "0.2", "--lam", "0.01", "--bed", "--out", t("scan")])
    found = scanfiles.read_occurrences(spark, t("scan/occurrences"))
    assert found.where("w IN ('AAGGTTCC', 'GGAACCTT')").count() >= 20
    cli.main(["stats", t("scan/occurrences"), t("scan/lengths"), "--out", t("stats")])
    assert spark.read.option("header", True).csv(t("stats/motifs")).count() == 1
    cli.main(["spacings", t("scan/occurrences"), "--evidence", "-1000000", "--out", t("sp")])
    cli.main(["filter", t("scan/occurrences"), "--threshold", "0.9", "--no-overlap", "--out", t("f")])
    assert 0 < scanfiles.read_occurrences(spark, t("f")).count() <= found.count()
    cli.main(["motifs", t("m"), "--pattern", "X-{name}", "--shuffle", "3", "--out", t("m2")])
    assert meme.read(spark, t("m2"))["motifs"][0].name == "X-M"


def test_pruning_and_sampling(spark):
    s = fasta.planted(spark, "AAGGTTCC", 40, 80, 0.1, 5).cache()
    model = background.markov(s, 1).cache()
    m = from_seed("M", "AAGGTTCC", 0.1)
    words = background.isolated_ll(sequences.word_counts(s, 8), model, 1, 8).cache()
    full = scan._strands(words, m, 0.01)
    left = sampling.pruned(words, m, 0.01, 0.3, 4)
    key = lambda x: sorted((r["w"], r["strand"]) for r in x.where("Z >= 0.3").collect())
    assert left.count() < words.count() and key(scan._strands(left, m, 0.01)) == key(full)
    exact = full.agg(F.sum(F.col("Z") * F.col("n"))).first()[0]
    got = [sampling.sampled_sum(words, m, 0.01, 400, seed).first()["estimate"] for seed in range(5)]
    assert sum(got) / 5 == pytest.approx(exact, rel=0.25)
