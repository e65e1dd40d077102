"""Significance of motifs: column log-likelihood-ratio p-values, E-values; numpy on the driver."""

from __future__ import annotations

import math

import numpy as np

from .pssm import Motif, column_information


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


class ColumnPValues:
    """ln P(LLR >= x) for ``n`` letters drawn from ``background``.

    The distribution of the statistic is built letter by letter on a lattice of ``steps``
    cells; weights are scaled by a Poisson-like tilt, so sums neither over- nor underflow.
    """

    def __init__(self, background: np.ndarray, n: int, steps: int = 0):
        b = np.asarray(background, float)
        q = max(2, steps or 2 * n)
        top = -n * math.log(b.min())
        self.n, self.delta, self.size = n, top / (q - 1), q
        fact = log_factorials(n)
        m = np.arange(n + 1)
        span = 2 * q + 8
        # state[c, j]: ln weight of c letters placed with lattice sum j (shifted so that it is never negative)
        state = np.full((n + 1, span), -np.inf)
        self.shift = q // 2
        state[0, self.shift] = 0.0
        for p in b:
            with np.errstate(divide="ignore", invalid="ignore"):
                stat = np.where(m > 0, m * (np.log(np.maximum(m, 1)) - math.log(n * p)), 0.0)
            step = np.floor(stat / self.delta + 0.5).astype(int)
            weight = m * math.log(p) - fact[m]
            new = np.full_like(state, -np.inf)
            for k in m:
                s = step[k]
                src = state[: n + 1 - k, max(0, -s) : span - max(0, s)]
                dst = new[k:, max(0, s) : span - max(0, -s)]
                np.logaddexp(dst, src + weight[k], out=dst)
            state = new
        pdf = state[n] + fact[n]
        tail = np.logaddexp.accumulate(pdf[::-1])[::-1]
        self.tail = np.minimum(tail - tail[0], 0.0)

    def __call__(self, llr: float) -> float:
        j = int(math.floor(llr / self.delta + 0.5)) + self.shift
        return float(self.tail[min(max(j, 0), len(self.tail) - 1)])


def exact_p(background: list[float], n: int, llr: float) -> float:
    """By enumeration of all compositions; for tests."""
    fact = log_factorials(n)
    total = 0.0

    def walk(i: int, left: int, stat: float, logp: float) -> None:
        nonlocal total
        p = background[i]
        if i == len(background) - 1:
            stat += left * math.log(left / (n * p)) if left else 0.0
            if stat >= llr - 1e-9:
                total += math.exp(logp + left * math.log(p) - fact[left] + fact[n])
            return
        for k in range(left + 1):
            walk(i + 1, left - k, stat + (k * math.log(k / (n * p)) if k else 0.0), logp + k * math.log(p) - fact[k])

    walk(0, n, 0.0, 0.0)
    return total


def log_product_p(logp: float, n: int) -> float:
    """ln P(product of ``n`` uniforms <= exp(logp))."""
    if logp >= 0:
        return 0.0
    terms = np.arange(n) * math.log(-logp) - log_factorials(n)[:n] if n else np.zeros(0)
    return min(0.0, logp + float(np.logaddexp.reduce(terms)))


def log_alignments(sites: int, places: int) -> float:
    """ln of the ways to choose sites; the quotients are whole-number divisions."""
    if sites > places:
        return math.inf
    total = 0.0
    for i in range(sites):
        total += math.log(max(1, ((places - i) * 2) // (i + 1)))
    return total


class Significance:
    """ln E-values of motifs; ``exact`` makes a table for each number of sites instead of the largest."""

    def __init__(self, background: np.ndarray, most: int, steps: int = 0, exact: bool = False):
        self.background, self.most, self.steps, self.exact = np.asarray(background), most, steps, exact
        self.tables: dict[int, ColumnPValues] = {}

    def column(self, n: int) -> ColumnPValues:
        n = n if self.exact else self.most
        if n not in self.tables:
            self.tables[n] = ColumnPValues(self.background, n, self.steps)
        return self.tables[n]

    def log_pop(self, motif: Motif, sites: int) -> float:
        n = min(self.most, int(sites))
        return sum(self.column(n)(n * ic) for ic in column_information(motif, self.background))

    def log_evalue(self, motif: Motif, sites: int, places: int) -> float:
        n = min(self.most, int(sites))
        return log_product_p(self.log_pop(motif, sites), motif.width) + log_alignments(n, places)
