"""What the operators share: input tables, the shared folder, cut lineage, exact hashing of splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; all executors see it.

    Only where none is named and all tasks run in this process's machine (tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="helixframe-")
        base = _own[context.applicationId]
    return f"{base.rstrip('/')}/helixframe/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` if Hadoop's file system still has it."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster's own retention takes over
        pass


def saved(df: DataFrame, keep: bool = False, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here, and lost executors lose nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    if not keep:
        atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixframe_path = path
    return out


def dealt(df: DataFrame, by: str, n: int) -> DataFrame:
    """As :func:`saved`, in ``n`` buckets by the column ``by``: what groups by it reads the buckets without a shuffle."""
    spark, path, name = df.sparkSession, shared_dir(df.sparkSession), f"helixframe_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("path", path).option("compression", "snappy").saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    return spark.table(name)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended, and its tables with it
        pass
    remove(spark, path)


def dropped(df: DataFrame) -> None:
    """Removes a table of :func:`saved` that nothing reads any more."""
    if path := getattr(df, "_helixframe_path", None):
        remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def split_mod(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(by))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; what else the table carries, clashing names too, stays out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: DuckDB has no crc32: CRC-32 (IEEE, reflected) of a decimal number's text, in plain SQL macros' stead.
def duck_crc(expr: str) -> str:
    """DuckDB expression: crc32 of the text ``expr``."""
    step = "list_reduce(list_prepend(({c})::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    byte = step.format(c="xor(s, b) & 255")
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({expr}, ''), lambda ch: ascii(ch)::BIGINT)),"
        f" lambda s, b: xor(s >> 8, {byte})), 4294967295)"
    )
