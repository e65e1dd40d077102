"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder of runs.  ``append`` writes an arrival as one run of small immutable
shards, without a shuffle.  ``compact`` groups all runs whose mean shard is below half the
target into tiers by their real size (each tier ``FANOUT`` times the one below) and
rewrites a tier of ``FANOUT`` shards or more as one run of files of about ``TARGET_BYTES``.  A
merged run that is still small enters a higher tier and is merged again later, so after
any number of appends fewer than ``FANOUT`` small shards are left in each tier.  The scan itself
packs whole small files into partitions of the target size, so merging needs no shuffle.

Every change commits a new version.  A writer reads version v and may only commit v + 1: the manifest is
written aside, then a marker, complete before it is visible, takes the version's name if nobody has it.
The loser of two writers reads the newer version and applies its change to that (an append
always can; a compaction only if its runs are still live), so no update is lost, and
readers see a whole version or none.  ``KEEP`` versions stay readable; runs that
only older ones name are removed.  Of a writer that dies before its marker, runs and manifest stay
without use, and no version shows them.  The driver holds the names of runs, as
Spark's own file index does; rows, manifests and counts stay in DataFrames.

Edge cases: an empty table commits a version without rows; null and repeated rows are kept
as they are; a text larger than a shard is a shard of its own; columns of any name are
stored as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import remove, shared_dir, table

TARGET_BYTES = 128 << 20
#: Shards of one tier that start a merge; also the ratio of sizes between tiers.
FANOUT = 4
#: Rows of an arrival's shard, at most.
ARRIVAL_ROWS = 4096
#: Arrivals that the query deals the documents into.
ARRIVALS = 4
#: Versions that stay readable.
KEEP = 3
#: Rows of a manifest's file, about.
MANIFEST_ROWS = 100_000

_MANIFEST = "run string, file string, bytes long, rows long"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _shard() -> Column:
    """A row's shard: its path within the store."""
    return F.concat(F.lit("run-"), F.substring_index(F.col("_metadata.file_path"), "/run-", -1))


class ShardStore:
    """Runs of immutable shards under versioned manifests at ``path``."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, keep: int = KEEP):
        self.spark, self.path, self.target, self.fanout, self.keep = spark, path.rstrip("/"), target_bytes, fanout, keep
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.path}/_commits"))

    def versions(self) -> list[int]:
        """Versions that can be read, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/_commits"))]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _name(self, version: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/_commits/{version:08d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version: run, file, bytes, rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/_manifests/{self._name(version)}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Makes ``shards``, derived from version ``base``, the next version; :class:`Conflict` if there is one already."""
        name = uuid.uuid4().hex
        shards = shards.select("run", "file", "bytes", "rows")
        shards.coalesce(1 + shards.count() // MANIFEST_ROWS).write.parquet(f"{self.path}/_manifests/{name}")
        aside = f"{self.path}/_commits/aside-{name}"
        stream = self._fs.create(self._path(aside), False)
        stream.writeUTF(name)
        stream.close()
        try:
            self._publish(aside, f"{self.path}/_commits/{base + 1:08d}")
        except Conflict:
            remove(self.spark, f"{self.path}/_manifests/{name}")
            raise
        finally:
            remove(self.spark, aside)
        self._expire(base + 1)
        return base + 1

    def _publish(self, aside: str, marker: str) -> None:
        """Gives a complete file its final name, unless the name is taken."""
        if self._fs.getUri().getScheme() == "file":  # a rename would replace the other's file here; a link never does
            local = lambda p: self._jvm.java.nio.file.Paths.get(self._path(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0))
            try:
                self._jvm.java.nio.file.Files.createLink(local(marker), local(aside))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    raise Conflict(marker) from None
                raise
            return
        if self._fs.exists(self._path(marker)) or not self._fs.rename(self._path(aside), self._path(marker)):
            raise Conflict(marker)

    def _expire(self, version: int) -> None:
        """Removes versions that are no longer kept, and the runs that only they name."""
        every = self.versions()
        old = [v for v in every if v <= version - self.keep]
        if not old:
            return
        runs = lambda vs: {r["run"] for v in vs for r in self.manifest(v).select("run").distinct().collect()}
        try:
            for run in runs(old) - runs([v for v in every if v not in old]):
                remove(self.spark, f"{self.path}/{run}")
                above = self._path(f"{self.path}/{run}").getParent()  # an append's folder of several runs
                if above.getName().startswith("run-") and not any(x.isDirectory() for x in self._fs.listStatus(above)):
                    remove(self.spark, above.toString())
            for v in old:
                name = self._name(v)
                remove(self.spark, f"{self.path}/_commits/{v:08d}")
                remove(self.spark, f"{self.path}/_manifests/{name}")
        except Exception as e:  # another writer is removing them too
            if "FileNotFound" not in str(e) and "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise

    def _listed(self, run: str) -> DataFrame:
        """What a written run holds; row counts are read from the files' own rows."""
        rows = self.spark.read.parquet(f"{self.path}/{run}").select(_shard().alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return rows.groupBy("file", "bytes").agg(F.count("*").alias("rows")).select(F.lit(run).alias("run"), "file", "bytes", "rows")

    def append(self, df: DataFrame, arrivals: int = 1) -> int:
        """Adds the rows as new runs of small shards; each of ``arrivals`` is one run."""
        stamp = f"run-{uuid.uuid4().hex}"
        writer = df.withColumn("_hf_arrival", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns[:1]]), F.lit(arrivals)))
        writer.write.option("maxRecordsPerFile", ARRIVAL_ROWS).partitionBy("_hf_arrival").parquet(f"{self.path}/{stamp}")
        runs = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{stamp}")) if s.isDirectory()]
        listed = [self._listed(f"{stamp}/{r}") for r in sorted(runs)]
        while True:
            base = self.version()
            new = self.manifest(base)
            for part in listed:
                new = new.unionByName(part)
            try:
                return self.commit(new, base)
            except Conflict:
                continue

    def compact(self) -> int:
        """Merges tiers until none has ``fanout`` small shards; returns the version."""
        while True:
            base = self.version()
            live = self.manifest(base)
            runs = live.groupBy("run").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes")).where(F.col("bytes") / F.col("shards") < self.target / 2)
            size = F.least(F.greatest(F.col("bytes"), F.lit(1)), F.lit(self.target)).cast("double")
            tier = F.floor(F.log(size) / F.log(F.lit(float(self.fanout))))
            tiers = runs.withColumn("tier", tier)
            first = tiers.groupBy("tier").agg(F.sum("shards").alias("shards"), F.sum("bytes").alias("bytes")).where(F.col("shards") >= self.fanout).orderBy("tier").first()
            if first is None:
                return base
            gone = sorted(r["run"] for r in tiers.where(F.col("tier") == first["tier"]).select("run").collect())
            merged = f"run-{uuid.uuid4().hex}"
            self._merge(gone, merged, -(-first["bytes"] // self.target))
            self._replace(base, gone, merged)

    def _replace(self, base: int, gone: list[str], merged: str) -> bool:
        """Commits that ``merged`` takes the place of ``gone``, if all of these are still live."""
        old = self.spark.createDataFrame([(r,) for r in gone], "run string")
        listed = self._listed(merged)
        while True:
            live = self.manifest(base)
            if live.join(old, "run", "left_semi").select("run").distinct().count() < len(gone):
                remove(self.spark, f"{self.path}/{merged}")  # another writer has merged some of them
                return False
            try:
                self.commit(live.join(old, "run", "left_anti").unionByName(listed), base)
                return True
            except Conflict:
                base = self.version()

    def _merge(self, runs: Iterable[str], merged: str, files: int) -> None:
        own = self.spark.newSession()  # its settings are nobody else's
        for k, v in {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
            own.conf.set(k, v)
        own.read.parquet(*[f"{self.path}/{r}" for r in runs]).coalesce(max(1, files)).write.parquet(f"{self.path}/{merged}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        runs = [r["run"] for r in self.manifest(version).select("run").distinct().collect()]
        if not runs:
            raise ValueError("the store has no rows")
        return self.spark.read.parquet(*[f"{self.path}/{r}" for r in runs])


def stored(docs: DataFrame, target_bytes: int = TARGET_BYTES, arrivals: int = ARRIVALS) -> tuple[DataFrame, int, DataFrame]:
    """Rows of a new store of ``docs`` with their ``shard``, the version, and the manifest as shard, shard_rows, shard_bytes."""
    spark = docs.sparkSession
    store = ShardStore(spark, shared_dir(spark), target_bytes)
    store.append(docs, arrivals)
    version = store.compact()
    names = store.manifest(version).select(F.col("file").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    if not names.limit(1).count():
        return docs.withColumn("shard", F.lit(None).cast("string")), version, names
    return store.read(version).withColumn("shard", _shard()), version, names


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, arrivals: int = ARRIVALS) -> DataFrame:
    """doc_id of every row with the shard that holds it: version, shard, shard_rows, shard_bytes."""
    rows, version, names = stored(docs.select("doc_id", *[F.col(f"`{c}`").alias("_hf_shard" if c == "shard" else c) for c in docs.columns if c != "doc_id"]), target_bytes, arrivals)
    return rows.select("doc_id", "shard").join(names, "shard", "left").select("doc_id", F.lit(version).alias("version"), "shard", F.coalesce("shard_rows", F.lit(0).cast("long")).alias("shard_rows"), F.coalesce("shard_bytes", F.lit(0).cast("long")).alias("shard_bytes"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store gives back for every document: doc_id, text_sha256, n_chars, store_rows (of the manifest), shard_ok (its shard is in the manifest, with as many rows as there are)."""
    rows, _, names = stored(table(spark, sf_dir, "documents"))
    held = rows.groupBy("shard").agg(F.count("*").alias("n"))
    good = names.join(held, "shard").where("n = shard_rows").select("shard", F.lit(True).alias("ok"))
    total = names.agg(F.coalesce(F.sum("shard_rows"), F.lit(0).cast("long")).alias("store_rows"))
    out = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_chars", "shard").join(good, "shard", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("doc_id", "text_sha256", "n_chars", "store_rows", F.coalesce("ok", F.lit(False)).alias("shard_ok"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the store of what is left, a row for each document (repeats of the mix too) with its shard."""
    ship(spark)
    return shard(docs)


ORACLE_SQL = """
SELECT doc_id, sha256(text) AS text_sha256, n_chars, count(*) OVER ()::BIGINT AS store_rows, true AS shard_ok FROM documents
"""
