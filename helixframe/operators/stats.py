"""Statistics of scan results: by motif, by sequence, curves and co-occurrence."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_motif(sites: DataFrame) -> DataFrame:
    return sites.groupBy("motif").agg(F.count("*").alias("n"), F.sum("Z").alias("sum_z"), F.min("Z").alias("min_z"), F.max("Z").alias("max_z"))


def density(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """(motif, seq, per_base): sites by possible starts; pairs without sites are left out (0)."""
    n = sites.groupBy("motif", "seq").agg(F.count("*").alias("n"), F.max(F.length("w")).alias("width"))
    places = F.col("length") - F.col("width") + 1
    return n.join(lengths, "seq").select("motif", "seq", F.when(places > 0, F.col("n") / places).otherwise(0.0).alias("per_base"))


def mean_density(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """(motif, n, bases, per_base): all sites by all possible starts."""
    n = sites.groupBy("motif").agg(F.count("*").alias("n"), F.max(F.length("w")).alias("width"))
    places = n.select("width").distinct().join(lengths.groupBy("length").agg(F.count("*").alias("k")), F.col("length") >= F.col("width")).groupBy("width").agg(F.sum((F.col("length") - F.col("width") + 1) * F.col("k")).alias("bases"))
    return n.join(places, "width").select("motif", "n", "bases", (F.col("n") / F.col("bases")).alias("per_base"))


def enrichment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Input over background of :func:`mean_density`."""
    y = b.select("motif", F.col("per_base").alias("bg_per_base"))
    return a.join(y, "motif", "left").select("motif", "per_base", "bg_per_base", F.try_divide("per_base", "bg_per_base").alias("ratio"))


def best_by_seq(sites: DataFrame) -> DataFrame:
    return sites.groupBy("motif", "seq").agg(F.max("Z").alias("best"))


def seq_long(sites: DataFrame) -> DataFrame:
    """(seq, motif, total, expected, best, anywhere); anywhere: chance of at least one site."""
    return sites.groupBy("seq", "motif").agg(
        F.count("*").alias("total"), F.sum("Z").alias("expected"), F.max("Z").alias("best"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("Z"), F.lit(1 - 1e-15)))))).alias("anywhere")
    )


def seq_wide(sites: DataFrame, lengths: DataFrame, motifs: list[str]) -> DataFrame:
    """A row for each sequence: length, total, expected, then count and expectation for each motif."""
    stats = [F.count("*").alias("total"), F.sum("Z").alias("expected")]
    for m in motifs:  # named columns, so no pass to find the motifs
        stats += [F.count_if(F.col("motif") == m).alias(f"n_{m}"), F.coalesce(F.sum(F.when(F.col("motif") == m, F.col("Z"))), F.lit(0.0)).alias(f"e_{m}")]
    g = sites.groupBy("seq").agg(*stats)
    return lengths.select("seq", "length").join(g, "seq", "left").na.fill(0)


def melt(wide: DataFrame, motifs: list[str]) -> DataFrame:
    """Wide to long: (seq, stat, value)."""
    names = [f"{k}_{m}" for m in motifs for k in ("n", "e")]
    return wide.select("seq", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["seq"], names, "stat", "value")


def cast(long: DataFrame, motifs: list[str], stats: tuple[str, ...] = ("total", "expected", "best", "anywhere")) -> DataFrame:
    """Long to wide: a column for each motif and statistic; absent ones 0."""
    pivot = long.groupBy("seq").pivot("motif", motifs).agg(*[F.first(s).alias(s) for s in stats])
    return pivot.na.fill(0)


def summary(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    a = sites.agg(F.count("*").alias("hits"), F.count_distinct("motif").alias("motifs"), F.min("Z").alias("min_z"), F.max("Z").alias("max_z"))
    return a.crossJoin(lengths.agg(F.count("*").alias("seqs"), F.sum("length").alias("bases")))  # single rows


def rank_curve(sites: DataFrame) -> DataFrame:
    """(motif, rank, Z): sites of a motif from the best down, ties by place."""
    return sites.select("motif", F.row_number().over(W.partitionBy("motif").orderBy(F.desc("Z"), "seq", "pos", "strand")).alias("rank"), "Z")


def coverage_curve(best: DataFrame) -> DataFrame:
    """(motif, rank, best): sequences by their best site."""
    return best.where("best > 0").select("motif", F.row_number().over(W.partitionBy("motif").orderBy(F.desc("best"), "seq")).alias("rank"), "best")


def position_curve(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """(motif, rank, scaled, quantile): centres over lengths, in order, against even quantiles."""
    x = sites.join(lengths, "seq").select("motif", "seq", "pos", "strand", ((F.col("pos") + F.length("w") / 2) / F.col("length")).alias("scaled"))
    by = W.partitionBy("motif").orderBy("scaled", "seq", "pos", "strand")
    n = F.count("*").over(W.partitionBy("motif"))
    r = F.row_number().over(by)
    return x.select("motif", r.alias("rank"), "scaled", F.when(n > 1, (r - 1) / (n - 1)).otherwise(0.0).alias("quantile"))


def cooccurrence(best: DataFrame) -> DataFrame:
    """(motif1, motif2, c): root of the sum of Z1 Z2 over the norm of Z2.

    Sequences are turned into one row of motif columns' products by a join on seq, which holds a row for a motif.
    """
    a, b = best.select("seq", F.col("motif").alias("motif1"), F.col("best").alias("z1")), best.select("seq", F.col("motif").alias("motif2"), F.col("best").alias("z2"))
    norm = best.groupBy(F.col("motif").alias("motif2")).agg(F.sqrt(F.sum(F.col("best") * F.col("best"))).alias("norm"))
    return a.join(b, "seq").groupBy("motif1", "motif2").agg(F.sum(F.col("z1") * F.col("z2")).alias("dot")).join(norm, "motif2").select("motif1", "motif2", F.try_divide(F.sqrt("dot"), "norm").alias("c"))


def length_listing(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("n"))


def joined(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer join of per-sequence tables (seq and numbers) by seq; first row of a seq wins, absent values are 0."""
    def first(name: str, t: DataFrame) -> DataFrame:
        cols = [c for c in t.columns if c != "seq"]
        return t.groupBy("seq").agg(*[F.first(c).alias(f"{name}_{c}") for c in cols])
    return reduce(lambda a, b: a.join(b, "seq", "full"), [first(n, t) for n, t in tables]).na.fill(0)


def cluster_sequences(wide: DataFrame, columns: list[str], seed: int = 1) -> DataFrame:
    """(seq, cluster): k-means over expectations, k = max(2, ln of the sequences)."""
    import math

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    n = wide.count()
    data = VectorAssembler(inputCols=columns, outputCol="x").transform(wide)
    fit = KMeans(k=max(2, int(math.log(max(2, n)))), featuresCol="x", predictionCol="cluster", seed=seed).fit(data)
    return fit.transform(data).select("seq", "cluster")


def header(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row: seqs, bases, sites, motifs, bases_per_site."""
    a = sites.agg(F.count("*").alias("sites"), F.count_distinct("motif").alias("motifs"))
    one = lengths.agg(F.count("*").alias("seqs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bases")).crossJoin(a)  # single rows
    return one.withColumn("bases_per_site", F.try_divide(F.col("bases").cast("double"), F.col("sites")))


def merges(gram: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Centroid clustering from dot products: (left, right, distance, size); the k-th merge is node n + k.  Ties go to smaller nodes."""
    n = len(gram)
    norm = np.diag(gram)
    d2 = {(i, j): max(0.0, float(norm[i] + norm[j] - 2 * gram[i, j])) for i in range(n) for j in range(i + 1, n)}
    size, out = dict.fromkeys(range(n), 1), []
    for node in range(n, 2 * n - 1):
        (a, b), best = min(d2.items(), key=lambda x: (x[1], x[0]))
        na, nb = size.pop(a), size.pop(b)
        at = lambda x, y: d2[min(x, y), max(x, y)]
        new = {(k, node): max(0.0, (na * at(k, a) + nb * at(k, b)) / (na + nb) - na * nb * best / (na + nb) ** 2) for k in size}
        d2 = {k: v for k, v in d2.items() if a not in k and b not in k} | new
        size[node] = na + nb
        out.append((a, b, best**0.5, na + nb))
    return out


def cluster_motifs(best: DataFrame, motifs: list[str]) -> list[tuple[int, int, float, int]]:
    """Centroid clustering of motifs as vectors of best Z by sequence; only motifs x motifs dot products leave the cluster."""
    a, b = best.select("seq", F.col("motif").alias("a"), F.col("best").alias("x")), best.select("seq", F.col("motif").alias("b"), F.col("best").alias("y"))
    at = {m: i for i, m in enumerate(motifs)}
    gram = np.zeros((len(motifs), len(motifs)))
    for r in a.join(b, "seq").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot")).where(F.col("a").isin(*motifs) & F.col("b").isin(*motifs)).collect():
        gram[at[r["a"]], at[r["b"]]] = r["dot"]
    return merges(gram)
