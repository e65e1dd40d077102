"""Overlaps, merging, non-overlapping selections, erasure and confusion counts of sites."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..session import ship
from . import sequences

#: Bases of a bin of the range joins.
BIN = 1024


def intervals(sites: DataFrame) -> DataFrame:
    return sites.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + F.length("w"))


def islands(sites: DataFrame, *keys: str) -> DataFrame:
    """Numbers chains of overlapping sites: adds ``island`` within the keys and seq."""
    by = W.partitionBy(*keys, "seq").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    return sites.withColumn("fresh", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("fresh")


def merged(sites: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, start, end, n): hulls of overlapping sites."""
    return islands(intervals(sites), *keys).groupBy(*keys, "seq", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def overlap_flags(sites: DataFrame) -> DataFrame:
    """(motif, seq, overlapping): whether neighbouring starts are less than a width apart."""
    by = W.partitionBy("motif", "seq").orderBy("pos", "strand")
    near = (F.lead("pos").over(by) - F.col("pos")) < F.length("w")
    return sites.withColumn("x", F.coalesce(near, F.lit(False))).groupBy("motif", "seq").agg(F.max("x").alias("overlapping"))


def _binned(x: DataFrame) -> DataFrame:
    return x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))))


def overlap_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intervals of one sequence that share bases, each once; (seq, start, end) on both sides.

    Binned, so that long sequences don't become one hot key: a pair meets in the bin of its
    first shared base.
    """
    right = _binned(b).select("seq", "bin", F.col("start").alias("start2"), F.col("end").alias("end2"), *[c for c in b.columns if c not in ("seq", "start", "end")])
    joined = _binned(a).join(right, ["seq", "bin"]).where("start < end2 AND start2 < end")
    return joined.where(F.floor(F.greatest("start", "start2") / BIN) == F.col("bin")).drop("bin")


def overlap_amount(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bases that two interval sets share; each set is merged first."""
    return overlap_join(a, b).agg(F.coalesce(F.sum(dna.overlap(F.col("start"), F.col("end"), F.col("start2"), F.col("end2"))), F.lit(0)).cast("long").alias("bases"))


def erased(windows: DataFrame, sites: DataFrame) -> DataFrame:
    """Windows (seq, pos, w) that share no base with a site: those whose prior is not erased."""
    cuts = intervals(sites).select("seq", "start", "end").distinct()
    hit = overlap_join(windows.select("seq", F.col("pos").alias("start"), (F.col("pos") + F.length("w")).alias("end")), cuts).select("seq", F.col("start").alias("pos")).distinct()
    return windows.join(hit, ["seq", "pos"], "left_anti")


def erased_free(seqs: DataFrame, sites: DataFrame, width: int) -> DataFrame:
    """As :func:`erased`, of all known windows of ``width`` of the sequences (seq, s): those of the stretches between the sites.

    Only tiles and sites are dealt out, never windows.
    """
    tile = sequences.TILE
    cuts = intervals(sites).select("seq", "start", "end").distinct()
    cuts = cuts.withColumn("tile", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - width + 1) / tile)), F.floor((F.col("end") - 1) / tile))))
    before = W.partitionBy("seq", "tile").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    origin = F.col("tile") * tile
    free = cuts.withColumn("from", F.coalesce(F.max("end").over(before), origin))
    ahead = F.when(F.col("start") - F.col("from") >= width, F.struct((F.col("from") - origin).cast("int").alias("a"), (F.col("start") - origin).cast("int").alias("b")))
    last = F.struct((F.max("end") - origin).cast("int").alias("a"), F.lit(tile + width - 1).alias("b"))
    gaps = free.groupBy("seq", "tile").agg(F.concat(F.collect_list(ahead), F.array(last)).alias("gaps"))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.lit(tile + width - 1).alias("b")))
    pieces = sequences.tiles(seqs, width).withColumn("tile", F.floor(F.col("offset") / tile)).join(gaps, ["seq", "tile"], "left").select("seq", "offset", "s", F.explode(F.coalesce("gaps", whole)).alias("x"))
    pieces = pieces.select("seq", (F.col("offset") + F.col("x.a")).alias("pos"), F.substring("s", F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("s"))
    found = pieces.select("seq", "pos", F.posexplode(dna.words(F.col("s"), width)).alias("i", "w")).select("seq", (F.col("pos") + F.col("i")).alias("pos"), "w")
    return found.where(~dna.has_unknown(F.col("w")))


def confusion(truth: DataFrame, predicted: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row tp, fp, fn, tn in bases; interval sets (seq, start, end) without overlaps of their own."""
    size = lambda x, name: x.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias(name))
    one = overlap_amount(truth, predicted).withColumnRenamed("bases", "tp").crossJoin(size(truth, "t")).crossJoin(size(predicted, "p"))  # single rows
    one = one.crossJoin(seqs.agg(F.sum(F.length("s")).cast("long").alias("n")))
    return one.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), (F.col("n") - F.col("t") - F.col("p") + F.col("tp")).alias("tn"))


def accuracy(c: DataFrame) -> DataFrame:
    """nSn, nPPV, nSp, nPC and nCC of confusion counts."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        F.try_divide(tp, tp + fn).alias("nSn"), F.try_divide(tp, tp + fp).alias("nPPV"), F.try_divide(tn, tn + fp).alias("nSp"), F.try_divide(tp, tp + fn + fp).alias("nPC"),
        F.try_divide(tp * tn - fn * fp, F.sqrt((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn))).alias("nCC"),
    )


def site_confusion(truth: DataFrame, predicted: DataFrame, share: float = 0.25) -> DataFrame:
    """One row stp, sfp, sfn in sites: a true site is found where a predicted one covers ``share`` of it.

    sfp counts the predicted sites that find none; interval sets (seq, start, end) are taken as distinct.
    """
    t, p = (x.select("seq", "start", "end").distinct() for x in (truth, predicted))
    shared = dna.overlap(F.col("start"), F.col("end"), F.col("start2"), F.col("end2"))
    met = overlap_join(t, p).where(shared >= F.lit(share) * (F.col("end") - F.col("start")))
    size = lambda x, name, *keys: x.select(*keys).distinct().agg(F.count("*").alias(name))
    one = size(met, "stp", "seq", "start", "end").crossJoin(size(met, "hit", "seq", "start2", "end2"))  # single rows
    one = one.crossJoin(size(t, "t", "*")).crossJoin(size(p, "p", "*"))
    return one.select("stp", (F.col("p") - F.col("hit")).alias("sfp"), (F.col("t") - F.col("stp")).alias("sfn"))


def site_accuracy(c: DataFrame) -> DataFrame:
    """sSn, sPPV and their mean sASP of a site confusion."""
    tp, fp, fn = (F.col(x).cast("double") for x in ("stp", "sfp", "sfn"))
    sn, ppv = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    return c.select(sn.alias("sSn"), ppv.alias("sPPV"), ((sn + ppv) / 2).alias("sASP"))


def _choose(z: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> list[int]:
    """In ``order``, the intervals that overlap none chosen before."""
    begun: list[int] = []  # of the chosen, in order; these never overlap, so neighbours decide
    ended: list[int] = []
    keep = []
    for i in order.tolist():
        s, e = int(start[i]), int(end[i])
        k = bisect.bisect_left(begun, s)
        if (k == 0 or ended[k - 1] <= s) and (k == len(begun) or begun[k] >= e):
            begun.insert(k, s)
            ended.insert(k, e)
            keep.append(i)
    return sorted(keep)


def _by_island(sites: DataFrame, per: str, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """``choose`` (positions of rows that stay) in each chain of overlapping sites; sites that stand alone, most of them, stay in the plan."""
    ship(sites.sparkSession)
    names = sites.columns
    chained = islands(intervals(sites), per)
    chained = chained.withColumn("_members", F.count("*").over(W.partitionBy(per, "seq", "island")))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return g.iloc[choose(g)][names]

    alone = chained.where("_members = 1").select(names)
    return alone.unionByName(chained.where("_members > 1").drop("_members").groupBy(per, "seq", "island").applyInPandas(run, sites.schema))


def greedy(sites: DataFrame, per: str = "motif") -> DataFrame:
    """Sites that overlap no better one that is kept; ties by position, then strand.

    Overlaps never leave a chain of overlapping sites, so chains are the groups: their
    number grows with the sequences and no long sequence is one task.
    """

    def choose(g: pd.DataFrame) -> list[int]:
        z, start = g["Z"].to_numpy(), g["pos"].to_numpy()
        return _choose(z, start, start + g["w"].str.len().to_numpy(), np.lexsort((g["strand"].to_numpy().astype(str), start, -z)))

    return _by_island(sites, per, choose)


def by_position(sites: DataFrame) -> DataFrame:
    """In order of position, of overlapping neighbours the better one; ties keep the earlier."""

    def choose(g: pd.DataFrame) -> list[int]:
        z, start = g["Z"].to_numpy(), g["pos"].to_numpy()
        end = start + g["w"].str.len().to_numpy()
        keep: list[int] = []
        for i in np.lexsort((g["strand"].to_numpy().astype(str), start)).tolist():
            if keep and start[i] < end[keep[-1]]:
                if z[i] > z[keep[-1]]:
                    keep[-1] = i
            else:
                keep.append(i)
        return keep

    return _by_island(sites, "motif", choose)
