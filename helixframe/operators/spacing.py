"""Pairs of sites at short distances: histograms, evidence and look-up of defined spacings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import intervals

DISTANCE = 30
BIN = 512


def close_pairs(sites: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs of disjoint sites of a sequence, the second beginning 0 to ``distance`` after the first ends.

    A band join by bins of the second's start, so no sequence is a hot key.  A bin is no less than the
    band, so a site has two bins at most; merged, as the planner doesn't count those copies when it
    picks a side to broadcast.
    """
    size = max(BIN, distance + 1)
    x = intervals(sites).select("seq", "motif", "strand", "start", "end", "w")
    first = x.select("seq", *[F.col(c).alias(f"{c}1") for c in ("motif", "strand", "start", "end", "w")]).withColumn("bin", F.explode(F.sequence(F.floor(F.col("end1") / size), F.floor((F.col("end1") + distance) / size))))
    second = x.select("seq", *[F.col(c).alias(f"{c}2") for c in ("motif", "strand", "start", "end", "w")]).withColumn("bin", F.floor(F.col("start2") / size))
    return first.join(second.hint("merge"), ["seq", "bin"]).where(F.col("start2").between(F.col("end1"), F.col("end1") + distance)).drop("bin")


def oriented(pairs: DataFrame, lengths: DataFrame | None = None, distance: int = DISTANCE) -> DataFrame:
    """(primary, secondary, same_strand, upstream, distance, seq, start, end) from either side.

    The right site is no primary of a pair of one motif.  With ``lengths`` (seq, length) sites
    too close to an end of their sequence for all spacings are no primaries.  The pairs are made once.
    """
    left, right = F.lit(True), F.col("motif1") != F.col("motif2")
    if lengths is not None:
        pairs = pairs.join(lengths, "seq")
        fits = lambda s, e, w: (F.col(s) >= distance + F.length(w)) & (F.col("length") - distance - F.length(w) > F.col(e) - 1)
        left, right = fits("start1", "end1", "w2"), right & fits("start2", "end2", "w1")
    sides = pairs.withColumn("_left", F.explode(F.array(F.lit(True), F.lit(False)))).where(F.when(F.col("_left"), left).otherwise(right))
    side = lambda a, b: F.when(F.col("_left"), a).otherwise(b)
    return sides.select(
        side(F.col("motif1"), F.col("motif2")).alias("primary"), side(F.col("motif2"), F.col("motif1")).alias("secondary"), (F.col("strand1") == F.col("strand2")).alias("same_strand"),
        side(F.col("strand1") == "-", F.col("strand2") == "+").alias("upstream"), (F.col("start2") - F.col("end1")).alias("distance"), "seq", F.col("start1").alias("start"), F.col("end2").alias("end"),
    )


def histogram(spacings: DataFrame) -> DataFrame:
    return spacings.groupBy("primary", "secondary", "same_strand", "upstream", "distance").agg(F.count("*").alias("n"))


def index(distance: int) -> Column:
    """Place of a spacing in a dense histogram of 4 * (distance + 1) cells."""
    d = distance + 1
    return F.col("distance") + F.col("upstream").cast("int") * d + F.col("same_strand").cast("int") * 2 * d


def dense(counts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(primary, secondary, cells): all cells, absent ones 0."""
    cells = 4 * (distance + 1)
    maps = counts.select("primary", "secondary", index(distance).alias("i"), "n").groupBy("primary", "secondary").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    return maps.select("primary", "secondary", F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("cells"))


def ln_gamma(x: Column) -> Column:
    """ln Gamma of a whole or real number of 1 or more, by Stirling's series beyond a shift of 8."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    down = None
    for k in range(8):
        down = F.log(x + k) if down is None else down + F.log(x + k)
    return series - down


def evidence(counts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(primary, secondary, n, log_evidence) against evenly spread spacings, each cell's prior 1."""
    cells = 4 * (distance + 1)
    total = counts.groupBy("primary", "secondary").agg(F.sum("n").alias("n"), F.sum(ln_gamma(F.col("n").cast("double") + 1)).alias("facts"))
    x = F.col("n").cast("double")
    value = F.lit(math.lgamma(cells)) - ln_gamma(x + cells) + F.col("facts") + x * math.log(cells)
    return total.select("primary", "secondary", "n", value.alias("log_evidence"))


def likelihoods(counts: DataFrame, distance: int = DISTANCE, alpha: float = 1.0) -> DataFrame:
    """(primary, secondary, n, log_choose, log_uniform, log_dirichlet): multinomial likelihoods of a pair's histogram.

    log_uniform: all cells are equally likely; log_dirichlet: cells have a Dirichlet prior of ``alpha >= 1`` each.
    Absent cells add nothing, so the sparse histogram is enough.
    """
    cells = 4 * (distance + 1)
    o, x = F.col("o").cast("double"), F.col("n").cast("double")
    by = counts.withColumnRenamed("n", "o").groupBy("primary", "secondary").agg(F.sum("o").alias("n"), F.sum(ln_gamma(o + 1)).alias("facts"), F.sum(ln_gamma(o + alpha) - math.lgamma(alpha)).alias("prior"))
    choose = ln_gamma(x + 1) - F.col("facts")
    return by.select(
        "primary", "secondary", "n", choose.alias("log_choose"), (choose - x * math.log(cells)).alias("log_uniform"),
        (choose + math.lgamma(alpha * cells) - ln_gamma(x + alpha * cells) + F.col("prior")).alias("log_dirichlet"),
    )


def without_inverse(pairs: DataFrame) -> DataFrame:
    """Of (a, b) and (b, a) the one of more evidence; ties keep the smaller primary."""
    key = F.struct(-F.col("log_evidence"), F.col("primary"))
    best = pairs.groupBy(F.least("primary", "secondary").alias("lo"), F.greatest("primary", "secondary").alias("hi")).agg(F.min_by(F.struct("primary", "secondary", "n", "log_evidence"), key).alias("x"))
    return best.select("x.*")


def find(spacings: DataFrame, definitions: DataFrame) -> DataFrame:
    """Spacings that a table of definitions names; the definitions are small next to the sites."""
    return spacings.join(definitions.select("primary", "secondary", "same_strand", "upstream", "distance").distinct(), ["primary", "secondary", "same_strand", "upstream", "distance"])


def undefined_motifs(definitions: DataFrame, sites: DataFrame) -> DataFrame:
    """Motifs of the definitions that no site has."""
    named = definitions.select(F.explode(F.array("primary", "secondary")).alias("motif")).distinct()
    return named.join(sites.select("motif").distinct(), "motif", "left_anti")


def offset_pairs(x: DataFrame, y: DataFrame, offsets: list[int], same: bool = True) -> DataFrame:
    """Sites of two motifs of a sequence whose offset in x's direction is one of ``offsets``."""
    b = y.select("seq", F.col("pos").alias("pos_y"), F.col("strand").alias("strand_y"), F.length("w").alias("w_y"))
    a = x.select("seq", F.col("pos").alias("pos_x"), F.col("strand").alias("strand_x"), F.length("w").alias("w_x"))
    reach = max(map(abs, offsets)) + 64
    a = a.withColumn("bin", F.explode(F.sequence(F.floor((F.col("pos_x") - reach) / BIN), F.floor((F.col("pos_x") + reach) / BIN))))
    joined = a.join(b.withColumn("bin", F.floor(F.col("pos_y") / BIN)), ["seq", "bin"])
    off = F.when(F.col("strand_x") == "+", F.col("pos_y") - F.col("pos_x")).otherwise(F.col("pos_x") + F.col("w_x") - F.col("pos_y") - F.col("w_y"))
    agree = F.col("strand_x") == F.col("strand_y")
    return joined.withColumn("offset", off).where(F.col("offset").isin(*offsets) & (agree if same else ~agree)).select("seq", "pos_x", "strand_x", "pos_y", "strand_y", "offset")
