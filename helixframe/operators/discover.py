"""Motif discovery: seeds, expectation maximisation, choice of the number of sites, several motifs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..session import ship
from . import background, em, intervals, scan, sequences
from .pssm import Motif, from_seed, geometric
from .significance import Significance

#: Distinct words that a seed is compared with in one task; the word table of a width is broadcast in such parts.
MAX_WORDS = 2_000_000


@dataclass
class Start:
    seed: str
    sites: int
    score: float


def site_bounds(n_seqs: int, low: int = 0, high: int = 0) -> tuple[int, int]:
    low = low or max(2, n_seqs // 10)
    high = high or min(10_000, max(low, 3 * n_seqs // 2))
    return min(low, high), max(low, high)


def widths(low: int = 6, high: int = 14) -> list[int]:
    return geometric(low, high, math.sqrt(2))


def _codes(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros((0, 1), np.int8)
    return np.searchsorted(np.frombuffer(b"ACGT", np.uint8), np.frombuffer("".join(words).encode(), np.uint8)).reshape(len(words), -1).astype(np.int8)


def starts(seqs: DataFrame, width: int, counts: list[int], significance: Significance, known_windows: int, every: int = 1, keep: int = 4) -> list[Start]:
    """The best seeds of ``width`` for each number of sites in ``counts``.

    Every canonical word is a seed (one of ``every``, by hash, if asked).  Its best words
    by matches, their occurrences counted, give the matrix for n sites; the score is
    minus its ln E-value.  Seeds are dealt to tasks; the distinct words are broadcast, within a bound.
    """
    ship(seqs.sparkSession)
    words = sequences.word_counts(seqs, width).persist()
    size = words.count()
    if size > MAX_WORDS:
        raise ValueError(f"{size} distinct words of width {width}; use a smaller width or more of `every`")
    table = words.toArrow()
    table = table.sort_by("w")
    held = seqs.sparkSession.sparkContext.broadcast((_codes(table.column("w").to_pylist()), table.column("n").to_numpy(), [significance, known_windows, counts]))
    seeds = words.select(dna.canonical(F.col("w")).alias("seed")).distinct().where(F.pmod(F.xxhash64("seed"), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, (sig, places, wanted) = held.value
        rc = 3 - codes[:, ::-1]
        for batch in batches:
            out: list[tuple[str, int, float]] = []
            for seed in batch.column(0).to_pylist():
                s = _codes([seed])[0]
                fwd, back = (codes == s).sum(1), (rc == s).sum(1)
                own = np.where((back > fwd)[:, None], rc, codes)
                best = np.argsort(-np.maximum(fwd, back), kind="stable")
                total = np.cumsum(n[best])
                for k in wanted:
                    stop = int(np.searchsorted(total, k)) + 1
                    used = best[:stop]
                    weight = n[used].astype(float)
                    weight[-1] -= max(0, weight.sum() - k)
                    probs = np.stack([np.bincount(own[used, i], weight, 4) for i in range(len(s))])
                    m = Motif(seed, probs / probs.sum(1, keepdims=True), k)
                    out.append((seed, k, -sig.log_evalue(m, k, places)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.float64())], names=["seed", "sites", "score"])

    found = seeds.mapInArrow(run, "seed string, sites int, score double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("sites").orderBy(F.desc("score"), "seed"))).where(F.col("r") <= keep).orderBy("sites", "r").collect()
    words.unpersist()
    return [Start(r["seed"], r["sites"], r["score"]) for r in best]


def discretise(windows: DataFrame, motif: Motif, lam: float, low: int, high: int, significance: Significance, places: int) -> tuple[float, int, Motif]:
    """(ln E-value, sites, motif) of the best number of sites among the best non-overlapping ones."""
    z = em.posteriors(windows, motif, lam).select(F.lit(motif.name).alias("motif"), "w", "seq", "pos", F.when(F.col("rc") == 0, "+").otherwise("-").alias("strand"), "Z")
    best = scan.best(z, high)
    word = F.when(F.col("strand") == "+", F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    sites = [r["o"] for r in best.select(word.alias("o"), "Z", "seq", "pos", "strand").orderBy(F.desc("Z"), "seq", "pos", "strand").collect()]  # ``high`` rows at most
    codes = _codes(sites)
    found = (math.inf, 0, motif)
    for n in range(low, min(high, len(sites)) + 1):
        counts = np.stack([np.bincount(codes[:n, i], minlength=4) for i in range(motif.width)]).astype(float)
        m = Motif(motif.name, counts / n, n)
        e = significance.log_evalue(m, n, places)
        if e < found[0]:
            found = (e, n, m)
    return found


def discover(seqs: DataFrame, motifs: int = 1, low: int = 0, high: int = 0, sizes: list[int] | None = None, order: int = 2, threshold: float = 0.3, every: int = 1, per_width: int = 4, iterations: int = em.MOST) -> list[dict]:
    """Motifs one after the other; predicted sites are erased before the next one is sought."""
    out: list[dict] = []
    low, high = site_bounds(seqs.count(), low, high)
    model = background.markov(seqs, order).persist()
    freqs = np.array([r["freq"] for r in background.frequencies(seqs, symmetric=False, pseudo=1).orderBy("base").collect()])
    significance = Significance(freqs, high)
    placed = sequences.globalise(seqs).select("seq", "gstart")
    gone: DataFrame | None = None
    for number in range(1, motifs + 1):
        tried = []
        for width in sizes or widths():
            own = background.window_ll(background.base_ll(seqs, model, order), width)
            own = intervals.erased(own, gone) if gone is not None else own
            own = em.prepared(own.join(placed, "seq").withColumn("gpos", F.col("gstart") + F.col("pos")).drop("gstart")).persist()
            places = own.count()
            text = seqs if gone is None else _masked(seqs, gone)
            for start in starts(text, width, geometric(low, high, math.sqrt(2)), significance, places, every, per_width):
                r = em.run_em(own, from_seed(f"HF-{number}", start.seed), start.sites, places, most=iterations)
                e, n, m = discretise(own, r.motif, r.lam, low, high, significance, places)
                tried.append((e, n, start.seed, m, r))
            own.unpersist()
        if not tried:
            break
        e, n, seed, m, r = min(tried, key=lambda x: (x[0], x[1], x[2]))
        sites = scan.scan(seqs, [m.with_pseudo(0.25)], model, order, r.lam, threshold, context=True)
        if gone is not None:
            sites = intervals.erased(sites, gone)
        sites = sites.persist()
        out.append({"motif": m, "log_evalue": e, "sites": n, "seed": seed, "iterations": r.iterations, "instances": sites})
        gone = sites if gone is None else gone.unionByName(sites)
    return out


def _masked(seqs: DataFrame, gone: DataFrame) -> DataFrame:
    """Sequences with the bases of found sites unknown."""
    cuts = intervals.merged(gone).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    hide = F.reduce("cuts", F.col("s"), lambda s, c: F.concat(F.substring(s, F.lit(1), c["start"]), F.repeat(F.lit("N"), c["end"] - c["start"]), F.substring(s, c["end"] + 1, F.length(s))))
    return seqs.join(cuts, "seq", "left").select("seq", "name", F.when(F.col("cuts").isNull(), F.col("s")).otherwise(hide).alias("s"))


def hamming_per_base(sites: DataFrame, consensus: str) -> DataFrame:
    word = F.when(F.col("strand") == "+", F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    return sites.groupBy("motif").agg((F.sum(dna.hamming(word, F.lit(consensus), len(consensus))) / (F.count("*") * len(consensus))).alias("per_base"))
