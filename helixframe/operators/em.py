"""Expectation maximisation of a weight matrix over all windows.

Windows, their background and the words' bounds are made once and cached; an iteration is one
job that returns 4 * W + 3 numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..session import ship
from .pssm import Motif, sum_over
from .scan import sites_lambda

EPSILON, W_SITES, PSEUDO, MOST, CLOSE = 0.4, 0.8, 0.01, 1000, 1e-5


@dataclass
class Result:
    motif: Motif
    lam: float
    iterations: int
    expected_sites: float
    log_likelihood: float
    converged: bool


def posteriors(windows: DataFrame, motif: Motif, lam: float, epsilon: float = 0.0) -> DataFrame:
    """``windows`` (w, ll, min_ll and what else) by strand with Z, without words below the bound.

    A word stays if its score reaches logit(epsilon * lam) - logit(lam) over the least
    background of its occurrences; epsilon 0 keeps all.
    """
    logp = motif.log()
    prior = math.log(lam / (1 - lam))
    both = F.array(F.struct(F.lit(0).alias("rc"), sum_over(F.col("w"), logp).alias("bs")), F.struct(F.lit(1).alias("rc"), sum_over(F.col("w"), logp[::-1, ::-1]).alias("bs")))
    rows = windows.withColumn("x", F.explode(both)).select("*", "x.rc", "x.bs").drop("x")
    if epsilon > 0:
        e = epsilon * lam
        rows = rows.where(F.col("bs") >= F.lit(math.log(e / (1 - e)) - prior) + F.col("min_ll"))
    return rows.withColumn("Z", dna.sigmoid(F.lit(prior) + F.col("bs") - F.col("ll")))


def prepared(windows: DataFrame) -> DataFrame:
    """(seq, pos, w, ll) with min_ll, the least background of each word's occurrences."""
    least = windows.groupBy("w").agg(F.min("ll").alias("min_ll"))
    return windows.join(least, "w")


def normalise_windows(z: DataFrame, width: int) -> DataFrame:
    """For each shift and each run of ``width`` positions with a Z over 1/width: where the sum of both
    strands is over 1, all but the largest shrink to make it 1.  Runs are aligned to global positions.

    Shifts follow one another, so a sequence is one group; long contigs should be cut at gaps first.
    """
    ship(z.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        gpos, rc, v = g["gpos"].to_numpy(), g["rc"].to_numpy(), g["Z"].to_numpy().copy()
        order = np.lexsort((rc, gpos))
        large = v > 1 / width
        for s in range(width):
            ok = gpos[order] >= s
            own = order[ok]
            if not len(own):
                continue
            bucket = (gpos[own] - s) // width
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            total = np.add.reduceat(v[own], cut)
            some = np.logical_or.reduceat(large[own], cut)
            for k in np.flatnonzero((total > 1) & some):
                part = own[cut[k] : cut[k + 1] if k + 1 < len(cut) else len(own)]
                top = part[v[part].argmax()]
                rest = v[part].sum() - v[top]
                if rest > 0:
                    v[part[part != top]] *= (1 - v[top]) / rest
        return g.assign(Z=v)

    return z.groupBy("seq").applyInPandas(run, z.schema)


def log_likelihood(lam: float, g: Column) -> Column:
    """Expected ln likelihood of a strand of a window with Z, bs and ll; ``g``: the prior chance that no site can be there."""
    site = F.log(1 - g) + math.log(lam) + F.col("bs")
    none = F.log((1 - g) * (1 - lam) + g) + F.col("ll")
    return F.when(F.col("Z") > 0, F.col("Z") * site).otherwise(0.0) + F.when(F.col("Z") < 1, (1 - F.col("Z")) * none).otherwise(0.0)


def step(z: DataFrame, width: int, lam: float) -> np.ndarray:
    """[4 * width] sums of Z by position and base in the motif's direction, then sum of Z and log-likelihood."""
    word = F.when(F.col("rc") == 0, F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    x = z.withColumn("o", word)
    sums = [F.coalesce(F.sum(F.when(dna.at(F.col("o"), i) == b, F.col("Z"))), F.lit(0.0)) for i in range(width) for b in "ACGT"]
    ll = log_likelihood(lam, F.col("g") if "g" in z.columns else F.lit(0.0))
    row = x.agg(*[s.alias(f"c{k}") for k, s in enumerate(sums)], F.coalesce(F.sum("Z"), F.lit(0.0)).alias("z"), F.coalesce(F.sum(ll), F.lit(0.0)).alias("ll")).first()
    return np.array(list(row), float)


def run_em(
    windows: DataFrame, motif: Motif, sites: float, known_windows: int, epsilon: float = EPSILON, w_sites: float = W_SITES, pseudo: float = PSEUDO, most: int = MOST, close: float = CLOSE, normalise: bool = True
) -> Result:
    """Iterates to a fixed point; ``windows``: seq, pos, gpos, w, ll (see :func:`prepared`)."""
    rows = (windows if "min_ll" in windows.columns else prepared(windows)).persist()
    lam, done, got = sites_lambda(sites, known_windows), False, None
    n = 0
    try:
        for n in range(1, most + 1):
            z = posteriors(rows, motif, lam, epsilon)
            if normalise:
                z = normalise_windows(z.select("seq", "gpos", "rc", "w", "ll", "bs", "Z"), motif.width)
            got = step(z, motif.width, lam)
            counts = got[: 4 * motif.width].reshape(-1, 4) + pseudo / 4
            new = Motif(motif.name, counts / counts.sum(1, keepdims=True), max(1, int(counts[-1].sum())))
            lam = sites_lambda((1 - w_sites) * got[-2] + w_sites * sites, known_windows)
            moved = float(np.linalg.norm(new.probs - motif.probs))
            motif = new
            if moved < close:
                done = True
                break
    finally:
        rows.unpersist()
    return Result(motif, lam, n, float(got[-2]) if got is not None else 0.0, float(got[-1]) if got is not None else 0.0, done)
