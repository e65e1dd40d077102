"""Weight matrices: driver-side numerics on small matrices and their Column forms."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"


@dataclass
class Motif:
    """Letter probabilities by position."""

    name: str
    probs: np.ndarray
    nsites: int = 20
    evalue: float | None = None
    altname: str | None = None
    url: str | None = None
    log_odds: np.ndarray | None = field(default=None, repr=False)

    @property
    def width(self) -> int:
        return len(self.probs)

    def with_pseudo(self, pseudo: float) -> Motif:
        """Counts (p * nsites) plus ``pseudo`` a cell, normalised again."""
        p = self.probs * self.nsites + pseudo
        return Motif(self.name, p / p.sum(1, keepdims=True), self.nsites, self.evalue, self.altname, self.url)

    def for_scan(self) -> Motif:
        """Each probability plus 1 / (nsites + 1), normalised again."""
        p = self.probs + 1 / (self.nsites + 1)
        return Motif(self.name, p / p.sum(1, keepdims=True), self.nsites, self.evalue, self.altname, self.url)

    def reverse_complement(self) -> Motif:
        return Motif(self.name, self.probs[::-1, ::-1].copy(), self.nsites, self.evalue, self.altname, self.url)

    def log(self) -> np.ndarray:
        return np.log(np.maximum(self.probs, 1e-300))

    def consensus(self, background: np.ndarray | None = None) -> str:
        p = self.probs if background is None else self.probs / background
        return "".join(BASES[i] for i in p.argmax(1))


def from_seed(name: str, seed: str, pseudo: float = 0.5) -> Motif:
    """One count for the seed's base and ``pseudo`` for every cell; N gives no count."""
    p = np.full((len(seed), 4), pseudo)
    for i, b in enumerate(seed):
        if b in BASES:
            p[i, BASES.index(b)] += 1
    return Motif(name, p / p.sum(1, keepdims=True), 1)


def from_sites(name: str, sites: list[str], pseudo: float = 1.0) -> Motif:
    """Counts of aligned sites of equal length."""
    if len({len(s) for s in sites}) != 1:
        raise ValueError("sites have different lengths")
    p = np.array([[sum(s[i] == b for s in sites) + pseudo for b in BASES] for i in range(len(sites[0]))])
    return Motif(name, p / p.sum(1, keepdims=True), len(sites))


def from_site_rows(name: str, sites: DataFrame, pseudo: float = 1.0) -> Motif:
    """:func:`from_sites` of a table (s: string) of any size: only counts come to the driver."""
    low, high, n = sites.agg(F.min(F.length("s")), F.max(F.length("s")), F.count("*")).first()
    if not n or low != high:
        raise ValueError("sites have different lengths" if n else "no sites")
    p = np.full((low, 4), pseudo)
    for r in sites.select(F.posexplode(F.split("s", "")).alias("i", "b")).where(F.col("b").isin(*BASES)).groupBy("i", "b").count().collect():
        p[r["i"], BASES.index(r["b"])] += r["count"]
    return Motif(name, p / p.sum(1, keepdims=True), n)


def uniform(name: str, width: int) -> Motif:
    return Motif(name, np.full((width, 4), 0.25))


def dirichlet(name: str, width: int, alpha: float, seed: int) -> Motif:
    return Motif(name, np.random.default_rng(seed).dirichlet([alpha] * 4, width))


def shuffled(m: Motif, seed: int) -> Motif:
    """The motif with its positions in random order."""
    order = np.random.default_rng(seed).permutation(m.width)
    return Motif(m.name, m.probs[order], m.nsites, m.evalue, m.altname, m.url)


def information(m: Motif) -> float:
    """Bits of nature over a uniform background."""
    p = m.probs
    return float(np.where(p > 0, p * np.log(np.where(p > 0, p, 1)), 0).sum() + m.width * math.log(4))


def column_information(m: Motif, background: np.ndarray) -> np.ndarray:
    p = m.probs
    return np.where(p > 0, p * (np.log(np.where(p > 0, p, 1)) - np.log(background)), 0).sum(1)


def log_odds(m: Motif, background: np.ndarray) -> np.ndarray:
    """Base-2 log odds with a fifth column for N, the background's mean."""
    lo = np.where(m.probs > 0, np.log2(np.maximum(m.probs, 1e-300)) - np.log2(background), 0.0)
    return np.concatenate([lo, (lo * background).sum(1, keepdims=True)], axis=1)


def scaled(lo: np.ndarray, top: int = 100) -> np.ndarray:
    """Whole numbers from 0 to ``top`` a position."""
    low, high = lo.min(), lo.max()
    return np.floor((lo - low) * (top / (high - low) if high > low else 0.0) + 0.5).astype(int)


def score_pdf(scores: np.ndarray, background: np.ndarray, top: int = 100) -> np.ndarray:
    """Distribution of the sum of scores under the background."""
    pdf = np.zeros(top * len(scores) + 1)
    pdf[0] = 1
    for row in scores:
        out = np.zeros_like(pdf)
        for b in range(4):
            s = int(row[b])
            out[s:] += background[b] * pdf[: len(pdf) - s]
        pdf = out
    return pdf


def right_tail(pdf: np.ndarray) -> np.ndarray:
    return np.clip(np.cumsum(pdf[::-1])[::-1], 0, 1)


def score_of(word: str, scores: np.ndarray) -> int:
    return int(sum(scores[i, BASES.find(b) if b in BASES else 4] for i, b in enumerate(word)))


def table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """(motif, col, base, p): a motif table in long form."""
    rows = [(m.name, i, b, float(m.probs[i, j])) for m in motifs for i in range(m.width) for j, b in enumerate(BASES)]
    return spark.createDataFrame(rows, "motif string, col int, base string, p double")


def sum_over(word: Column, matrix: np.ndarray, kind: str = "double") -> Column:
    """Sum of ``matrix[i, base i]`` over the word; a fifth column is for N."""
    out = None
    for i, row in enumerate(matrix):
        b = F.substring(word, i + 1, 1)
        x = F.when(b == "A", F.lit(row[0].item())).when(b == "C", F.lit(row[1].item())).when(b == "G", F.lit(row[2].item())).when(b == "T", F.lit(row[3].item()))
        x = (x.otherwise(F.lit(row[4].item())) if len(row) > 4 else x).cast(kind)
        out = x if out is None else out + x
    return out


def geometric(low: int, high: int, factor: float) -> list[int]:
    """Whole numbers from ``low``, growing by ``factor`` (one at least), ending with ``high``."""
    out, x = [], low
    while x < high:
        out.append(x)
        x = max(x + 1, int(x * factor))
    return [*out, high]
