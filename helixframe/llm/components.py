"""Connected components, and link counting inside candidate groups, without all-pairs rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions, saved

#: Members of a candidate group that one task compares; larger groups are dealt out as pairs of tiles.
TILE = 2048


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b: long) reach from each of their nodes.

    Alternates large-star and small-star steps until nothing changes.  Each step is a
    map-side combined minimum and a join that adaptive execution splits where a hub is
    hot; every round is written to the shared folder, so lineage stays short.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = saved(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        dropped(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tiles(group: Column, member: Column, size: Column, tile: int = TILE) -> Column:
    """Structs (gid, side): the task groups that a member of a group of ``size`` belongs to.

    A group of up to ``tile`` members is one task group.  A larger one is cut by a hash of the
    member into k tiles; each pair of tiles is a task group, so every pair meets in just one.
    """
    k = F.ceil(size / F.lit(tile)).cast("long")
    own = F.pmod(F.xxhash64(member), k)
    pair = lambda j: F.struct(F.xxhash64(group, F.least(own, j), F.greatest(own, j)).alias("gid"), own.alias("tile"), (own != j).alias("cross"))
    return F.when(k <= 1, F.array(F.struct(F.xxhash64(group, F.lit(0), F.lit(0)).alias("gid"), F.lit(0).cast("long").alias("tile"), F.lit(False).alias("cross")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), k - 1), pair)
    )


def grouped(df: DataFrame, by: str, fn: Callable[[pa.Table], pa.Table | None], schema: str, whole: bool = False) -> DataFrame:
    """``fn`` over the rows of each value of the long column ``by``, many small groups to an Arrow batch; if ``whole``, over many complete groups at once."""
    n = partitions(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def parts(table: pa.Table) -> Iterator[pa.Table]:
            key = table.column(by).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            if whole:  # complete groups, up to a tile's rows together
                a = 0
                while a < len(key):
                    b = int(cut[max(np.searchsorted(cut, a + TILE, side="right") - 1, np.searchsorted(cut, a, side="right"))])
                    yield table.slice(a, b - a)
                    a = b
                return
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if b - a > 1:
                    yield table.slice(a, b - a)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(by).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # sorted: rows of the last group may go on in the next batch
            if rest and rest[-1].column(by)[-1].as_py() == key[-1]:
                if last == 0:
                    rest.append(batch)
                    continue
            done = pa.Table.from_batches([*rest, batch.slice(0, last)]) if rest or last else None
            if done is not None and done.num_rows:
                for part in parts(done.combine_chunks()):
                    if (out := fn(part)) is not None:
                        yield from out.to_batches()
            rest = [batch.slice(last)]
        if rest:
            for part in parts(pa.Table.from_batches(rest).combine_chunks()):
                if (out := fn(part)) is not None:
                    yield from out.to_batches()

    return df.repartition(n, by).sortWithinPartitions(by).mapInArrow(run, schema)


def roots(linked: np.ndarray) -> np.ndarray:
    """Component number of each member of a symmetric boolean matrix."""
    n = len(linked)
    comp = np.full(n, -1)
    for i in range(n):
        if comp[i] >= 0:
            continue
        comp[i] = i
        front = np.array([i])
        while len(front):
            reach = linked[front].any(0) & (comp < 0)
            front = np.flatnonzero(reach)
            comp[front] = i
    return comp
