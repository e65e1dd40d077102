"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the vectors.

The rotation is learnt on a bounded sample of ``SAMPLE`` vectors; every vector gets its
binary code, whose substrings are the keys of the multi-index tables.  Substrings grow with the
number of vectors, so buckets keep their expected size, and tables are added until made pairs at the
threshold meet with the wanted recall.  Rows of equal label and vector are one class.

Three steps keep the exchange small: (1) key, class and code of all tables are dealt by key, and pairs in a bucket are
compared by the Hamming distance of their codes, whose limit ``RECALL`` of the made pairs keep;
(2) of the members that have such a partner, and for whom this is the first table where the two meet, the
original vectors are fetched; (3) these are compared by their exact cosine in double precision.  A
bucket beyond ``TILE`` members is dealt out in pairs of tiles, so no task meets an
unbounded group; a task reports link counts and a spanning forest, never the pairs.

Edge cases: null, zero and non-finite vectors, null labels and null ids link with nothing
and are returned; every row is a vector of its own, whether its id is used again or not (ids
are long integers); vectors of different lengths never link; the rotation is learnt for the
``LENGTHS`` commonest lengths, others get codes of random hyperplanes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import saved, table
from .components import components, grouped, roots, tiles

THRESHOLD = 0.98
#: Vectors that the rotation is learnt from, at most.
SAMPLE = 20_000
#: Wanted share of pairs at the threshold that meet in some table.
RECALL = 0.9999
#: Members that a bucket of one label has on average.
BUCKET = 32
ITERATIONS = 40
#: Pairs that the recall is measured on, and codes that are made for it, at most, before substrings get shorter.
PROBES = 50_000
MOST_CODES = 24
#: Lengths of vectors that a rotation is learnt for.
LENGTHS = 16
#: Cosines this near the threshold are computed again in extended precision.
CLOSE = 1e-9
#: Members of a bucket that one task compares.
TILE = 2048


def learn(x: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection of an ITQ code of ``bits`` bits for unit vectors ``x``."""
    mean = x.mean(0)
    v = x - mean
    _, vec = np.linalg.eigh(v.T @ v / max(1, len(v)))
    pca = vec[:, ::-1][:, :bits]
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    v = v @ pca
    for _ in range(ITERATIONS):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, pca @ r


def at_threshold(x: np.ndarray, threshold: float, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``PROBES`` pairs of unit vectors of cosine ``threshold``: vectors of ``x`` and turned ones.

    Half of them are turned in a random direction, half in that of the vectors' own differences.
    """
    rng = np.random.default_rng(seed)
    a = x[rng.integers(0, len(x), PROBES)]
    d = rng.standard_normal(a.shape)
    own = x[rng.integers(0, len(x), PROBES // 2)] - x[rng.integers(0, len(x), PROBES // 2)]
    d[: PROBES // 2] = np.where(np.linalg.norm(own, axis=1, keepdims=True) > 1e-9, own, d[: PROBES // 2])
    d -= (d * a).sum(1, keepdims=True) * a
    size = np.linalg.norm(d, axis=1, keepdims=True)
    ok = size[:, 0] > 1e-9  # in one dimension there is nowhere to turn
    a, d = a[ok], d[ok] / size[ok]
    return a, threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * d


def keys_of(v: np.ndarray, codes: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The tables' keys of unit vectors."""
    return np.concatenate([((v - mean) @ proj >= 0).reshape(len(v), proj.shape[1] // width, width) @ (1 << np.arange(width, dtype=np.int64)) for mean, proj in codes], axis=1)


def plan(x: np.ndarray, n: int, threshold: float, recall: float) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Bits of a substring, and as many codes as reach ``recall`` at ``threshold`` on pairs made from ``x``.

    ``n``: vectors of the largest label.  Substrings are shortened where ``MOST_CODES`` codes don't do.
    """
    a, b = at_threshold(x, threshold)
    dim = x.shape[1]
    width = min(dim, max(8, min(24, math.ceil(math.log2(max(2, n) / BUCKET)))))
    while True:
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        apart = np.ones(len(a), bool)
        while len(codes) < MOST_CODES:
            codes.append(learn(x, dim // width * width, len(codes)))
            ka, kb = keys_of(a[apart], codes[-1:], width), keys_of(b[apart], codes[-1:], width)
            met = np.logical_or.accumulate(ka == kb, axis=1)
            enough = np.flatnonzero((~met).sum(0) <= (1 - recall) * len(a))
            if len(enough):  # no more tables than it takes
                mean, proj = codes[-1]
                codes[-1] = (mean, proj[:, : (int(enough[0]) + 1) * width])
                return width, codes
            apart[apart] = ~met[:, -1]
        if width == 1:
            return width, codes
        width -= 1


def reach(x: np.ndarray, width: int, codes: list[tuple[np.ndarray, np.ndarray]], threshold: float, recall: float) -> int:
    """Hamming distance of whole codes that ``recall`` of the made pairs at ``threshold`` keep."""
    a, b = at_threshold(x, threshold, 2)
    if not len(a):
        return 0
    d = np.bitwise_count(keys_of(a, codes, width) ^ keys_of(b, codes, width)).sum(1)
    return int(np.quantile(d, 1 - (1 - recall) / 10, method="higher")) + 1


def hyperplanes(dim: int, n: int, threshold: float, recall: float) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], int]:
    """Width, codes and reach by random hyperplanes, where agreement follows from the angle alone."""
    agree = 1 - math.acos(threshold) / math.pi
    width = max(4, min(16, math.ceil(math.log2(max(2, n) / BUCKET))))
    count = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    proj = np.random.default_rng(dim).standard_normal((dim, count * width))
    bits = count * width
    return width, [(np.zeros(dim), proj)], math.ceil(bits * (1 - agree) + 5 * math.sqrt(bits * agree * (1 - agree)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.array(flat, dtype=np.float64).reshape(n, -1)


def links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame | None:
    """(cid, links, root) pieces to be summed; ``classes``: cid, lab (hash of the label), x, n (rows)."""
    shape = classes.groupBy(F.size("x").alias("dim"), "lab").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("every")).orderBy(F.desc("every"), "dim")
    first = shape.limit(LENGTHS).collect()
    if not first:
        return None
    out = None
    for s in first:
        own = classes.where(F.size("x") == s["dim"])
        sample = own.where(F.pmod(F.col("cid"), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / s["every"]) * (1 << 30))).select("x").toArrow()
        x = unit(_vectors(sample.column(0), sample.num_rows)) if sample.num_rows else np.zeros((1, s["dim"]))
        width, codes = plan(x, s["n"], threshold, recall)
        held = classes.sparkSession.sparkContext.broadcast((width, codes, reach(x, width, codes, threshold, recall)))
        part = _links(own, lambda _, held=held: held.value, threshold)
        out = part if out is None else out.unionByName(part)
    rest = shape.where(~F.col("dim").isin([s["dim"] for s in first])).agg(F.max("n")).first()[0]
    if rest:
        out = out.unionByName(_links(classes.where(~F.size("x").isin([s["dim"] for s in first])), _Made(rest, threshold, recall), threshold))
    return out


_hyperplanes = lru_cache(16)(hyperplanes)


class _Made:
    """Codes of random hyperplanes for any length, made where they are needed."""

    def __init__(self, n: int, threshold: float, recall: float):
        self.args = n, threshold, recall

    def __call__(self, dim: int) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], int]:
        return _hyperplanes(dim, *self.args)


def _links(classes: DataFrame, model: Callable[[int], tuple], threshold: float) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array(batch.column(2).value_lengths())
            for dim in np.unique(size).tolist():
                pick = batch.take(pa.array(np.flatnonzero(size == dim)))
                width, codes, most = model(dim)
                keys = keys_of(unit(_vectors(pick.column(2), pick.num_rows)), codes, width)
                n, tables = keys.shape
                sig = np.ascontiguousarray(keys.astype(np.uint32)).view(np.uint8).reshape(n, -1)
                sig = pa.Array.from_buffers(pa.binary(4 * tables), n, [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [pick.column(0), pick.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t].astype(np.int32)), pa.array(np.full(n, most, np.int32)), sig],
                        names=["cid", "lab", "dim", "t", "sub", "most", "sig"],
                    )

    coded = classes.select("cid", "lab", "x").mapInArrow(code, "cid long, lab long, dim int, t int, sub int, most int, sig binary")
    coded = saved(coded.select("cid", "t", "most", "sig", F.xxhash64("lab", "dim", "t", "sub").alias("key")))
    sizes = coded.groupBy("key").count()
    large = sizes.where(F.col("count") > TILE)
    dealt = coded.join(large, "key", "left").withColumn("to", F.explode(F.when(F.col("count").isNull(), F.array(F.struct(F.col("key").alias("gid"), F.lit(0).cast("long").alias("tile"), F.lit(False).alias("cross")))).otherwise(tiles(F.col("key"), F.col("cid"), F.coalesce("count", F.lit(1)), TILE))))
    near = saved(grouped(dealt.select("to.gid", "to.tile", "to.cross", "cid", "t", "most", "sig"), "gid", _candidates, "gid long, tile long, cross boolean, cid long, t int, sig binary"))
    loaded = near.join(classes.select("cid", "lab", "x", "n"), "cid")

    def compare(g: pa.Table) -> pa.Table | None:
        n, tile = g.num_rows, g.column("tile").to_numpy()
        keys = _signatures(g)
        v = _vectors(g.column("x"), n)
        u = unit(v)
        cos = u @ u.T
        ok = cos >= threshold
        lab = g.column("lab").to_numpy()
        ok &= lab[:, None] == lab
        i, j = np.nonzero(np.abs(cos - threshold) < CLOSE)
        for k, m in zip(i.tolist(), j.tolist(), strict=True):
            a, b = v[k].astype(np.longdouble), v[m].astype(np.longdouble)
            ok[k, m] = lab[k] == lab[m] and (a * b).sum() >= np.longdouble(threshold) * np.sqrt((a * a).sum() * (b * b).sum())
        np.fill_diagonal(ok, False)
        if not ok.any():
            return None
        comp = roots(ok)
        ok &= _first(keys, keys, g.column("t")[0].as_py())
        if g.column("cross")[0].as_py():
            ok &= tile[:, None] != tile
        cid = g.column("cid").to_numpy()
        return pa.table({"cid": cid, "links": ok @ g.column("n").to_numpy(), "root": cid[comp]})

    return grouped(loaded, "gid", compare, "cid long, links long, root long")


def _signatures(g: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(g.num_rows, -1)


def _first(a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Which pairs meet in table ``t`` and in none before."""
    ok = a[:, None, t] == b[None, :, t]
    for k in range(t):
        ok &= a[:, None, k] != b[None, :, k]
    return ok


def _candidates(g: pa.Table) -> pa.Table | None:
    """Members of a bucket that have a partner within the Hamming distance, met here first."""
    keys, tile = _signatures(g), g.column("tile").to_numpy()
    n, t, most = g.num_rows, g.column("t")[0].as_py(), g.column("most")[0].as_py()
    wide = np.zeros((n, keys.shape[1] + keys.shape[1] % 2), np.uint32)
    wide[:, : keys.shape[1]] = keys
    wide = np.ascontiguousarray(wide).view(np.uint64)
    cross, some = g.column("cross")[0].as_py(), np.zeros(n, bool)
    for a in range(0, n, 256):
        d = np.zeros((min(256, n - a), n), np.uint16)
        for k in range(wide.shape[1]):
            d += np.bitwise_count(wide[a : a + 256, None, k] ^ wide[None, :, k])
        near = d <= most
        near[np.arange(len(d)), np.arange(a, a + len(d))] = False
        if cross:
            near &= tile[a : a + 256, None] != tile
        i, j = np.nonzero(near)
        if t and len(i):
            ok = (keys[a + i, :t] != keys[j, :t]).all(1)
            i, j = i[ok], j[ok]
        some[a + i] = some[j] = True
    if not some.any():
        return None
    return g.filter(pa.array(some)).select(["gid", "tile", "cross", "cid", "t", "sig"])


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    ship(vectors.sparkSession)
    x = F.col("x")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{embedding}`").alias("x"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0)
    rows = rows.withColumn("cid", F.when(good, F.xxhash64("label", "x")))
    classes = saved(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.first(F.xxhash64("label")).alias("lab"), F.first("x").alias("x"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    found = links(classes)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found)
    count = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    named = classes.select("cid", "n", "least").join(count, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    named = named.join(heads, "component").select("cid", "head", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("own"))
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    head = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return out.select("vec_id", F.coalesce("own", F.lit(0)).cast("long").alias("n_links"), head.alias("component_id"), head.eqNullSafe(F.col("vec_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.98),
r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT n, min(m) AS component FROM r GROUP BY 1)
SELECT vec_id, coalesce((SELECT count(*) FROM e WHERE e.a = vec_id), 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.n = vec_id
"""
