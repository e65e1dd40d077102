"""Mixing sources to target weights: Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document draws the key -ln(u) / w, u from a hash of its id and w its quality
weight; within a source, ascending keys are a weighted sample without replacement.  A
source takes its documents floor(target / size) times in full, then in key order up to the
rest of its word budget (a document is taken if its middle lies within the budget, so a
source misses its target by half a document at most).

The prefix sums never gather a source in one task: keys are dealt to bins of about
``BIN_ROWS`` rows, bin sums are summed up, and only the bin where a source's budget ends is
ordered by a window.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source, the
last; rows with equal (or null) ids share a draw, so they are in one bin, and are ordered by size; a source of size 0 has target
0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import plain, saved, table

CYCLE = 3
MOST = 3
BIN_ROWS = 5000
#: Quality weights by label: good, bad; 1 where there is no label.
GOOD, BAD = 2.0, 0.5


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight, stopped at ``MOST`` times the size.

    The fixed point of resharing is one level L with target = min(cap, L * weight): with
    sources in order of cap / weight, the first whose cap reaches the level set by what is left.
    """
    rank = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", (F.row_number().over(rank) - 1) % CYCLE + 1).withColumn("cap", F.col("source_size") * MOST)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    zero = F.lit(0).cast("long")
    s = s.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).cast("double"),
    ).withColumn("at", F.row_number().over(order))
    found = s.where(F.col("cap") >= F.col("level") * F.col("weight")).agg(F.min_by("level", "at").alias("found"))
    return s.join(F.broadcast(found)).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("found") * F.col("weight")).alias("target"))


def draw(doc_id: Column) -> Column:
    """A number in (0, 1) that follows from the id."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the columns ``carry``) for every row."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), *[F.col(f"`{c}`") for c in carry])
    if quality is not None:
        best = quality.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("doc_id IS NOT NULL")
        rows = rows.join(best, "doc_id", "left").withColumn("w", F.when(F.col("quality") > 0, GOOD).when(F.col("quality") <= 0, BAD).otherwise(1.0)).drop("quality")
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    rows = saved(rows.withColumn("key", -F.log(draw(F.col("doc_id"))) / F.col("w")).drop("w"))
    bins = max(1, rows.count() // BIN_ROWS)
    # by the smallest weight, so that no weight crowds a bin: at most GOOD / BAD times the mean
    rows = rows.withColumn("bin", F.floor((1 - F.exp(-F.col("key") * min(GOOD, BAD, 1.0))) * bins))
    sums = saved(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    goal = targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    upto = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = (
        sums.withColumn("upto", F.sum("bin_size").over(upto)).join(goal.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_")))
        .withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .select(F.col("source").alias("source_"), F.col("bin").alias("bin_"), "source_size", "target", "epochs", "rest", (F.col("upto") - F.col("bin_size")).alias("before"), "upto")
    )
    placed = rows.join(edge, F.col("source").eqNullSafe(F.col("source_")) & (F.col("bin") == F.col("bin_")))
    cut = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    within = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = placed.where(cut).withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("more", (F.col("start") + F.col("size") / 2 <= F.col("rest")).cast("long")).drop("start")
    whole = placed.where(~cut).withColumn("more", (F.col("upto") <= F.col("rest")).cast("long"))
    return whole.unionByName(ordered).select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken"), *carry)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document as often as the mix takes it."""
    ship(spark)
    names = docs.columns
    keyed = docs.withColumn("_hf_hash", F.xxhash64("`text`"))
    taken = mix(keyed, table(spark, sf_dir, "labels"), carry=("_hf_hash",)).where("taken > 0")
    times = taken.select(F.col("doc_id").alias("_hf_doc"), F.col("_hf_hash").alias("_hf_th"), (F.col("taken") / F.col("size")).cast("int").alias("_hf_n"))
    once = times.groupBy("_hf_doc", "_hf_th").agg(F.sum("_hf_n").alias("_hf_n"), F.count("*").alias("_hf_rows"))
    # rows of one id and text are alike: together they carry what the mix takes of them
    order = F.row_number().over(W.partitionBy("doc_id", "_hf_hash").orderBy(F.lit(0)))
    many = once.where("_hf_rows > 1")
    got = keyed.join(once.where("_hf_rows = 1"), F.col("doc_id").eqNullSafe(F.col("_hf_doc")) & F.col("_hf_hash").eqNullSafe(F.col("_hf_th")))
    if many.limit(1).count():
        twins = keyed.join(many, F.col("doc_id").eqNullSafe(F.col("_hf_doc")) & F.col("_hf_hash").eqNullSafe(F.col("_hf_th"))).withColumn("_hf_at", order).where("_hf_at = 1").drop("_hf_at")
        got = got.unionByName(twins)
    return plain(got.withColumn("_hf_i", F.explode(F.sequence(F.lit(1), F.col("_hf_n").cast("int")))), *names)


ORACLE_SQL = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
d AS (SELECT documents.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        -ln((('0x' || substr(md5(documents.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
          / CASE WHEN quality > 0 THEN 2.0 WHEN quality <= 0 THEN 0.5 ELSE 1.0 END AS key
      FROM documents LEFT JOIN q ON q.doc_id = documents.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS at_row,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, at_row) FROM l WHERE cap >= level * weight) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN start + size / 2 <= rest AND (start < rest OR size = 0) THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
