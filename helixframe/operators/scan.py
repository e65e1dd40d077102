"""Weight-matrix scanning: posteriors of both strands, thresholds, scores and p-values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from . import background, sequences
from .pssm import Motif, log_odds, right_tail, scaled, score_pdf, sum_over

LAMBDA, THRESHOLD = 0.001, 0.3
#: Rows (words of a width, for each motif and strand) up to which all words are scored and those that pass are broadcast.
MOST_SENT = 1 << 19


def sites_lambda(sites: float, known_windows: int) -> float:
    """Chance of a site for a strand of a window."""
    return min(0.99, min(1.0, sites / (2 * max(1, known_windows))))


def _scored(rows: DataFrame, motifs: list[Motif], lam: float) -> DataFrame:
    """motif, strand and Z of both strands for rows with w and ll; the background is the forward window's on both."""
    prior = math.log(lam / (1 - lam))
    z = lambda m: dna.sigmoid(F.lit(prior) + sum_over(F.col("w"), m) - F.col("ll"))
    both = [F.struct(F.lit(m.name).alias("motif"), F.lit(strand).alias("strand"), z(logp).alias("Z")) for m in motifs for strand, logp in (("+", m.log()), ("-", m.log()[::-1, ::-1]))]
    return rows.withColumn("x", F.explode(F.array(*both))).select("*", "x.motif", "x.strand", "x.Z").drop("x")


def _strands(rows: DataFrame, motif: Motif, lam: float) -> DataFrame:
    return _scored(rows, [motif], lam).drop("motif")


def scan(seqs: DataFrame, motifs: list[Motif], model: DataFrame, order: int, lam: float = LAMBDA, threshold: float = THRESHOLD, context: bool = False) -> DataFrame:
    """(motif, w, seq, pos, strand, Z) of all sites with Z of ``threshold`` or more.

    With the word's own background each distinct word is scored once, and only words that
    pass are joined with their places.  There are at most 4 ** width words: where that is few, all are scored
    and those that pass are broadcast, so the places are not dealt out.  ``context`` takes the background of the place instead.
    """
    out = None
    base = background.base_ll(seqs, model, order) if context else None
    for width in sorted({m.width for m in motifs}):
        own = [m for m in motifs if m.width == width]
        if context:
            part = _scored(background.window_ll(base, width), own, lam).where(F.col("Z") >= threshold).select("motif", "w", "seq", "pos", "strand", "Z")
        else:
            places = sequences.windows(seqs, width)
            few = 4**width * 2 * len(own) <= MOST_SENT
            words = sequences.all_words(seqs.sparkSession, width) if few else places.select("w").distinct()
            hits = _scored(background.isolated_ll(words, model, order, width), own, lam).where(F.col("Z") >= threshold).select("motif", "w", "strand", "Z")
            part = places.join(F.broadcast(hits) if few else hits, "w").select("motif", "w", "seq", "pos", "strand", "Z")
        out = part if out is None else out.unionByName(part)
    return out


def decorate(sites: DataFrame, motifs: list[Motif], freqs: np.ndarray) -> DataFrame:
    """Adds score and pvalue: whole-number log odds of the site in the motif's direction."""
    out = None
    for m in motifs:
        lo = scaled(log_odds(m, freqs))
        tail = right_tail(score_pdf(lo, freqs))
        word = F.when(F.col("strand") == "+", F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
        score = sum_over(word, lo, "int")
        values = F.lit([float(x) for x in tail])
        part = sites.where(F.col("motif") == m.name).withColumn("score", score).withColumn("pvalue", F.element_at(values, F.col("score") + 1))
        out = part if out is None else out.unionByName(part)
    return out


def include_exclude(sites: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    out = sites.where(F.col("Z") >= threshold)
    out = out.where(F.col("motif").isin(*include)) if include else out
    return out.where(~F.col("motif").isin(*exclude)) if exclude else out


def best(sites: DataFrame, k: int, per: str = "motif", slack: float = 2.5) -> DataFrame:
    """The ``k`` best non-overlapping sites for each motif: greedy among the ``slack * k`` best."""
    from .intervals import greedy

    ranked = sites.withColumn("r", F.row_number().over(W.partitionBy(per).orderBy(F.desc("Z"), "seq", "pos", "strand"))).where(F.col("r") <= int(slack * k))
    kept = greedy(ranked.drop("r"), per)
    return kept.withColumn("r", F.row_number().over(W.partitionBy(per).orderBy(F.desc("Z"), "seq", "pos", "strand"))).where(F.col("r") <= k).drop("r")
