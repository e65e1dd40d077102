"""Background models: base frequencies, Markov tables, log-likelihoods of bases and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from . import sequences

BASE_TABLE = "array('A','C','G','T')"


def frequencies(seqs: DataFrame, pseudo: float = 0.0, symmetric: bool = True) -> DataFrame:
    """(base, n, freq); ``symmetric`` shares A with T and C with G."""
    c = sequences.composition(seqs).where("base <> 'N'")
    pair = F.when(F.col("base").isin("A", "T"), "AT").otherwise("CG")
    n = F.col("n") + F.lit(pseudo)
    all_ = W.partitionBy()
    share = F.sum(n).over(W.partitionBy(pair)) / 2 if symmetric else n
    return c.select("base", "n", F.try_divide(share, F.sum(n).over(all_)).alias("freq"))


def markov_counts(seqs: DataFrame, order: int) -> DataFrame:
    """(k, ctx, base, n) of the forward strand for all orders up to ``order``.

    One pass counts the longest words; shorter words are their suffixes, and the words
    that a known run begins with are added from the runs' first bases.
    """
    width = order + 1
    padded = seqs.select("seq", F.concat(F.lit("N" * order), "s").alias("s"))
    words = sequences.short_counts(padded, width).where(~F.col("w").endswith("N"))
    tails = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("w", width - k, k + 1).alias("x")) for k in range(order + 1)])
    part = words.select("n", F.explode(tails).alias("t")).where(~dna.has_unknown(F.col("t.x"))).groupBy("t.k", "t.x").agg(F.sum("n").alias("n"))
    return part.select("k", F.expr("substring(x, 1, k)").alias("ctx"), F.expr("substring(x, k + 1, 1)").alias("base"), "n")


def markov(seqs: DataFrame, order: int, pseudo: float = 1.0) -> DataFrame:
    """(k, ctx, base, n, logp): complete tables, each cell with a pseudo-count."""
    counts = markov_counts(seqs, order)
    spark = seqs.sparkSession
    cells = None
    for k in range(order + 1):
        ctx = spark.range(4**k).select("id")
        text = F.concat(*[F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]) if k else F.lit("")
        part = ctx.select(F.lit(k).alias("k"), text.alias("ctx"), F.explode(F.expr(BASE_TABLE)).alias("base"))
        cells = part if cells is None else cells.unionByName(part)
    full = cells.join(counts, ["k", "ctx", "base"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    context = W.partitionBy("k", "ctx")
    p = F.try_divide(F.col("n") + F.lit(pseudo), F.sum("n").over(context) + F.lit(4 * pseudo))
    return full.select("k", "ctx", "base", "n", F.when(p > 0, F.log(p)).alias("logp"))


def word_table(model: DataFrame, order: int) -> DataFrame:
    """(x, ll) for every word of order + 1 signs over ACGTN: log-likelihood of its last base.

    The order used is the number of known bases right before it; an unknown base counts ln(1/4).
    """
    keyed = model.select(F.concat("ctx", "base").alias("tail"), "logp")
    spark = model.sparkSession
    size = order + 1
    x = F.concat(*[F.substring(F.lit("ACGTN"), (F.floor(F.col("id") / 5**i) % 5 + 1).cast("int"), F.lit(1)) for i in range(size)])
    words = spark.range(5**size).select(x.alias("x")).withColumn("tail", F.regexp_extract("x", "([ACGT]*)$", 1))
    return words.join(keyed, "tail", "left").select("x", F.when(F.col("tail") == "", F.lit(math.log(0.25))).otherwise(F.col("logp")).alias("ll"))


def base_ll(seqs: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(seq, pos, base, ll) for every base; a broadcast look-up of its word of order + 1 signs."""
    padded = seqs.select("seq", F.concat(F.lit("N" * order), "s").alias("s"))
    words = sequences.windows(padded, order + 1, known=False)
    table = F.broadcast(word_table(model, order))  # 5 ** (order + 1) rows
    return words.join(table, words["w"] == table["x"]).select("seq", "pos", F.substring("w", order + 1, 1).alias("base"), "ll")


def cumulative_ll(base: DataFrame) -> DataFrame:
    upto = W.partitionBy("seq").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return base.withColumn("cum_ll", F.sum("ll").over(upto))


def window_ll(base: DataFrame, width: int) -> DataFrame:
    """(seq, pos, w, ll) of the known windows, each in the context of its sequence."""
    ahead = W.partitionBy("seq").orderBy("pos").rowsBetween(0, width - 1)
    out = base.withColumn("ll", F.sum("ll").over(ahead)).withColumn("w", F.array_join(F.collect_list("base").over(ahead), ""))
    return out.where((F.length("w") == width) & ~dna.has_unknown(F.col("w"))).select("seq", "pos", "w", "ll")


def isolated_ll(words: DataFrame, model: DataFrame, order: int, width: int) -> DataFrame:
    """``words`` (column w, distinct) with ll: the word by itself, first bases at lower orders."""
    parts = [F.substring("w", max(1, i + 1 - order), min(i, order) + 1) for i in range(width)]
    keyed = model.select(F.concat("ctx", "base").alias("x"), "logp")
    exploded = words.select("w", F.explode(F.array(*parts)).alias("x"))
    ll = exploded.join(F.broadcast(keyed), "x").groupBy("w").agg(F.sum("logp").alias("ll"))  # 4 ** (order + 1) rows and less
    return words.join(ll, "w")
