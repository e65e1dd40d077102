"""Scalar functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna


def rc(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def ham(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def shifted(a, b):
    n = len(a)
    return min([ham(a, b)] + [s + ham(a[s:], b[: n - s]) for s in range(1, n)] + [s + ham(b[s:], a[: n - s]) for s in range(1, n)])


@pytest.fixture(scope="module")
def pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ACGT") for _ in range(6))
    return spark.createDataFrame([(word(), word()) for _ in range(60)], "a string, b string")


def test_words_and_distances(pairs):
    a, b = F.col("a"), F.col("b")
    out = pairs.select("a", "b", dna.reverse_complement(a).alias("rc"), dna.canonical(a).alias("c"), dna.hamming(a, b, 6).alias("h"), dna.shifted_distance(a, b, 6).alias("s"), dna.shifted_distance_rc(a, b, 6).alias("r"), dna.word_ordinal(a, 6).alias("o")).collect()
    for x in out:
        assert x["rc"] == rc(x["a"]) and x["c"] == min(x["a"], rc(x["a"]))
        assert x["h"] == ham(x["a"], x["b"]) and x["s"] == shifted(x["a"], x["b"])
        assert x["r"] == min(x["s"], shifted(rc(x["a"]), x["b"]))
        assert x["o"] == sum("ACGT".index(c) * 4**i for i, c in enumerate(x["a"]))


def test_scalars(spark):
    x = spark.range(1).select(
        dna.normalise(F.lit("ac gT\nnrx")).alias("n"), dna.first_unknown(F.lit("ACNT")).alias("u"), dna.first_unknown(F.lit("AC")).alias("v"), dna.base_ordinal(F.lit("g")).alias("g"), dna.base_ordinal(F.lit("x")).alias("x"),
        dna.log_sum(F.lit(1.0), F.lit(2.0)).alias("ls"), dna.log_difference(F.lit(2.0), F.lit(1.0)).alias("ld"), dna.x_log_y(F.lit(0.0), F.lit(0.0)).alias("xy"), dna.overlap(F.lit(1), F.lit(5), F.lit(3), F.lit(9)).alias("ov"),
        dna.words(F.lit("ACGT"), 3).alias("w"), dna.odds_to_probability(F.lit(3.0)).alias("p"), dna.from_text(F.lit("Ab-1 é")).alias("t"),
    ).first()
    assert (x["n"], x["u"], x["v"], x["g"], x["x"], x["xy"], x["ov"], x["w"], x["p"], x["t"]) == ("ACGTNNN", 2, None, 2, 4, 0.0, 2, ["ACG", "CGT"], 0.75, "ACN")
    assert abs(x["ls"] - 2.313261687518223) < 1e-12 and abs(x["ld"] - 1.541324854612918) < 1e-12
