"""N-gram Jaccard self-join: MinHash banding, then exact verification on the full shingle sets.

Texts whose five-word shingle sets are equal form one class, represented once.  Each
class gets ``BANDS`` band hashes of ``ROWS`` minima; a shuffle on band hashes brings the members of
a bucket together.  There pairs are kept whose signatures (a byte of each minimum) agree
in ``LEAST`` places or more, each in the first band where the two meet.  The full shingle sets travel only
to the buckets where a member has such a partner, and the pairs are verified exactly: texts
that merely share boilerplate meet in many buckets, but don't send their sets there.  A bucket beyond
``TILE`` members, or ``TILE_SHINGLES`` shingles, is dealt out in pairs of tiles.  Tasks report link counts and a
spanning forest, not pairs, so a group of any number of copies stays linear in what
it emits, and no link is lost.

Recall at similarity s is that of the bands, 1 - (1 - s**ROWS)**BANDS, 0.999997 at 0.8, times that of the signatures,
0.9999 at 0.8 (binomial, 96 places).

Edge cases: a text of one to four words has one shingle, all its words; a null or
wordless text has no shingle and links with nothing; repeated rows (equal ids too) are
rows of their own and link with each other; an empty table gives no rows; other columns
are ignored; ids are long integers.  A very long text is one task's, with some 100 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import kernel
from .common import plain, saved, table
from .components import components, grouped, roots, tiles

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Equal bytes of two signatures, of BANDS * ROWS, that make a pair worth verifying.
LEAST = 62
#: Members of a bucket that one task compares, and shingles of the sets it verifies; of each two tiles are in memory.
TILE = 1500
TILE_SHINGLES = 4 << 20

U = np.uint64
_A = np.random.default_rng(20240229).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def band_keys(sets: np.ndarray, cut: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes ``[row, band]`` and signatures of the non-empty sets ``sets[cut[i]:cut[i + 1]]``."""
    n = len(cut) - 1
    sig = np.empty((n, bands * rows), dtype=U)
    for a in range(0, n, 128):
        b = min(n, a + 128)
        part, at = sets[cut[a] : cut[b]], cut[a:b] - cut[a]
        for k in range(bands * rows):
            sig[a:b, k] = np.minimum.reduceat(part * _A[k], at)
    key = np.zeros((n, bands), dtype=U)
    for r in range(rows):
        key = kernel.mix(key * U(kernel.MULT) + sig[:, r::rows])
    return key, (kernel.mix(sig) >> U(56)).astype(np.uint8)


def unique_sets(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.unique(h[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _sums(sets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Order-free 64-bit name of each non-empty set."""
    x = np.add.reduceat(kernel.mix(sets ^ U(0x9FB21C651E98DF25)), cut[:-1])
    return kernel.mix(x * U(kernel.MULT) + np.diff(cut).astype(U)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in kernel.slices(batch.column(2)):
            h, offs = kernel.words(batch.column(2).slice(a, b - a), kernel.ALNUM)
            sets, cut = unique_sets(*kernel.shingles(h, offs, SHINGLE))
            size = np.diff(cut)
            full = np.flatnonzero(size)
            cid, keys, sig = np.zeros(b - a, np.int64), np.zeros((b - a, BANDS), dtype=np.int64), np.zeros((b - a, BANDS * ROWS), np.uint8)
            if len(full):
                own = np.append(cut[full], cut[-1])
                cid[full] = _sums(sets, own)
                k, sig[full] = band_keys(sets, own)
                keys[full] = k.view(np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32), pa.array(keys[full].reshape(-1)))
            signs = np.concatenate([sig, (keys >> 32).astype(np.int32).view(np.uint8).reshape(b - a, -1)], axis=1)
            signs = pa.Array.from_buffers(pa.binary(SIGN), b - a, [None, pa.py_buffer(np.ascontiguousarray(signs))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()), pa.array(cid, mask=size == 0), lists, signs], names=["doc_id", "th", "size", "cid", "keys", "sig"])


#: Bytes of a member's signature and of the digests of its band hashes.
SIGN = BANDS * ROWS + 4 * BANDS


def _signs(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and digests of the band hashes."""
    x = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint8).reshape(g.num_rows, SIGN)
    return x[:, : BANDS * ROWS], np.ascontiguousarray(x[:, BANDS * ROWS :]).view(np.uint32)


def _met(digest: np.ndarray, i: np.ndarray | int, j: np.ndarray, band: int) -> np.ndarray:
    """Whether the members ``i`` and ``j`` meet in ``band``, and in none before."""
    same = digest[i] == digest[j]
    return same[:, band] & ~same[:, :band].any(1)


def _candidates(threshold: float):
    def candidates(g: pa.Table) -> pa.Table | None:
        sig, digest = _signs(g)
        n, band, cross, tile, size = g.num_rows, g.column("band")[0].as_py(), g.column("cross")[0].as_py(), g.column("tile").to_numpy(), g.column("size").to_numpy()
        some = np.zeros(n, bool)
        step = max(1, (8 << 20) // (n * sig.shape[1]))
        for a in range(0, n, step):
            i = np.arange(a, min(n, a + step))
            ok = np.minimum(size[i, None], size) >= threshold * np.maximum(size[i, None], size) - 1e-9
            ok &= np.arange(n) > i[:, None]
            if cross:
                ok &= tile[i, None] != tile
            x, y = np.nonzero(ok)
            x = x + a
            for c in range(0, len(x), 1 << 16):
                u, v = x[c : c + (1 << 16)], y[c : c + (1 << 16)]
                good = (sig[u] == sig[v]).sum(1) >= LEAST
                u, v = u[good], v[good]
                good = _met(digest, u, v, band)
                some[u[good]] = some[v[good]] = True
        if not some.any():
            return None
        return g.filter(pa.array(some)).select(["gid", "tile", "cross", "band", "cid", "sig", "size"])

    return candidates


def _verify(threshold: float):
    def verify(g: pa.Table) -> pa.Table | None:
        cid = g.column("cid").to_numpy()
        _, first = np.unique(cid, return_index=True)
        if len(first) < 2:
            return None
        g = g.take(pa.array(np.sort(first)))
        cid, weight, tile, cross, band = g.column("cid").to_numpy(), g.column("n").to_numpy(), g.column("tile").to_numpy(), g.column("cross")[0].as_py(), g.column("band")[0].as_py()
        # tiles of the candidates' step and of the verification's: a pair counts where both put it
        near, beside = g.column("near").to_numpy(), g.column("beside")[0].as_py()
        _, digest = _signs(g)
        sets = [np.frombuffer(x, U) for x in g.column("sets").to_pylist()]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        vocabulary, code = np.unique(flat, return_inverse=True)
        cut = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(len(vocabulary), np.int32)
        n = len(cid)
        ok = np.zeros((n, n), bool)
        for i in range(n - 1):
            # partners that meet in this band first and could reach the threshold by size
            j = np.arange(i + 1, n)
            j = j[_met(digest, np.full(len(j), i), j, band)]
            j = j[(np.minimum(size[j], size[i]) >= threshold * np.maximum(size[j], size[i]) - 1e-9)]
            if cross:
                j = j[tile[j] != tile[i]]
            if beside:
                j = j[near[j] != near[i]]
            if not len(j):
                continue
            mark[code[cut[i] : cut[i + 1]]] = 1
            step = max(1, (4 << 20) // int(size[j].max()))
            for a in range(0, len(j), step):
                part = j[a : a + step]
                _, at = kernel.runs(cut[part], size[part])
                both = np.add.reduceat(mark[code[at]], np.concatenate([[0], np.cumsum(size[part])[:-1]]))
                hit = part[both >= threshold * (size[i] + size[part] - both) - 1e-9]
                ok[i, hit] = ok[hit, i] = True
            mark[code[cut[i] : cut[i + 1]]] = 0
        if not ok.any():
            return None
        comp = roots(ok)
        return pa.table({"cid": cid, "links": ok @ weight, "root": cid[comp]})

    return verify


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th (hash of the text), class_id, copy_id, n_links, keep for every row.

    class_id: the smallest doc_id that links reach; copy_id: the smallest with the same shingles;
    keep: the row is one that stays (rows with equal id and text share the answer).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    sig = saved(rows.mapInArrow(_signatures, "doc_id long, th long, size long, cid long, keys array<long>, sig binary"))
    classes = saved(
        sig.where("cid IS NOT NULL").groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    )
    banded = classes.select("cid", F.posexplode("keys").alias("band", "key")).select("cid", "band", F.xxhash64("band", "key").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    dealt = banded.join(buckets, "key").select("cid", "band", F.explode(tiles(F.col("key"), F.col("cid"), F.col("members"), TILE)).alias("to"))
    where = dealt.groupBy("cid").agg(F.collect_list(F.struct("band", "to.*")).alias("to"))
    met = classes.join(where, "cid").select("cid", "sig", "size", F.explode("to").alias("to")).select("cid", "sig", "size", "to.*")
    kind = "gid long, tile long, cross boolean, band int, cid long, sig binary, size long"
    near = saved(grouped(met, "gid", _candidates(threshold), kind))
    # sets that wouldn't fit together in one task are dealt out again
    large = near.groupBy("gid").agg(F.sum("size").alias("all")).where(F.col("all") > TILE_SHINGLES)
    alone = F.array(F.struct(F.col("gid"), F.lit(0).cast("long").alias("tile"), F.lit(False).alias("cross")))
    to = F.when(F.col("all").isNull(), alone).otherwise(tiles(F.col("gid"), F.xxhash64(F.lit(1), "cid"), F.coalesce("all", F.lit(1)), TILE_SHINGLES))
    member = (
        near.join(large, "gid", "left").withColumn("to", F.explode(to))
        .select("cid", "sig", "band", "tile", "cross", F.col("to.gid").alias("gid"), F.col("to.tile").alias("near"), F.col("to.cross").alias("beside"))
        .groupBy("cid").agg(F.first("sig").alias("sig"), F.collect_list(F.struct("gid", "tile", "cross", "near", "beside", "band")).alias("to"))
        .join(classes.select("cid", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th")), "cid")
    )

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.slices(batch.column(4)):
                part = batch.slice(a, b - a)
                sets, cut = unique_sets(*kernel.shingles(*kernel.words(part.column(4), kernel.ALNUM), SHINGLE))
                own = pa.array([sets[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                lists = part.column(3)
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                size = np.diff(cut)[of]
                edge = np.concatenate([[0], np.cumsum(size)])
                c = 0
                while c < len(of):  # copies of long sets go out a few megabytes at a time
                    d = max(c + 1, int(np.searchsorted(edge, edge[c] + (1 << 20), side="right")) - 1)
                    at = pa.array(of[c:d])
                    few = flat.slice(c, d - c)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), *[few.field(k) for k in range(6)], own.take(at)], names=["cid", "n", "sig", "gid", "tile", "cross", "near", "beside", "band", "sets"])
                    c = d

    texts = member.join(rows, (rows["doc_id"].eqNullSafe(member["doc_id"])) & (rows["th"] == member["th"])).dropDuplicates(["cid"]).select("cid", "n", "sig", "to", rows["text"])
    loaded = texts.mapInArrow(with_sets, "cid long, n long, sig binary, gid long, tile long, cross boolean, near long, beside boolean, band int, sets binary")
    found = saved(grouped(loaded, "gid", _verify(threshold), "cid long, links long, root long"))
    count = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    named = classes.select("cid", "first", "n").join(count, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    named = named.join(heads, "component").select("cid", "first", "n", "links", "head")
    out = sig.select("doc_id", "th", "cid").join(named, "cid", "left")
    alone = F.col("cid").isNull()
    return out.select(
        "doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("copy_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        (alone | F.struct("doc_id", "th").eqNullSafe(F.struct("head.doc_id", "head.th"))).alias("keep"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", F.col("keep").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each class stays (of rows with equal id and text, one)."""
    ship(spark)
    found = saved(near_duplicates(docs))
    gone = found.where("NOT keep").select(F.col("doc_id").alias("_hf_doc"), F.col("th").alias("_hf_th")).distinct()
    names = docs.columns
    keyed = docs.withColumn("_hf_hash", F.xxhash64(F.col("`text`")))
    left = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_hf_doc")) & (F.col("_hf_hash") == F.col("_hf_th")), "left_anti")
    again = found.where("keep AND n_links > 0").groupBy("doc_id", "th").count().where("count > 1")
    if again.limit(1).count():
        left = left.dropDuplicates(["doc_id", "_hf_hash"])
    return plain(left, *names)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE p.c >= 0.8 * (x.n + y.n - p.c) - 1e-9),
r(n, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT n, min(m) AS component FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, coalesce(component, doc_id) AS class_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN c ON c.n = doc_id LEFT JOIN l ON l.a = doc_id
"""
