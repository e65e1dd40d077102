"""FASTA reader and writer, planted-site generator and parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, s); name is the whole header line, records without name and bases are dropped.

    Records are split by the text source, so large files are read in parallel.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"))
    cut = F.locate("\n", F.col("v"))
    parts = raw.select("f", "block", F.trim(F.when(cut > 0, F.substring("v", F.lit(1), cut - 1)).otherwise(F.col("v"))).alias("name"), F.when(cut > 0, dna.normalise(F.expr("substring(v, locate('\n', v) + 1)"))).otherwise("").alias("s"))
    full = parts.where("name <> '' OR s <> ''")
    return numbered(full, "seq").select("seq", "name", "s")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their number in order of file (f) and place; block: the start of the row's split.

    Only a number for each split is summed up in one task; the rows stay where they are read.
    """
    placed = rows.withColumn("_at", F.monotonically_increasing_id())  # rises by one within a split
    splits = placed.groupBy("f", "block").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("f", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(splits.withColumn("_before", before), ["f", "block"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_low")).drop("_at", "_low", "_n", "_before")


def from_strings(spark: SparkSession, seqs: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "seq long, name string, s string")
    return rows.select("seq", "name", dna.normalise(F.col("s")).alias("s"))


def write(seqs: DataFrame, path: str, width: int = 60) -> None:
    lines = F.regexp_replace("s", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines)).write.text(path)


def first_word(name: str = "name"):
    """The id that other tools take from a header."""
    return F.element_at(F.split(name, r"\s+"), 1)


def region(name: str = "name"):
    """chrom:start-end of a header as a struct; absent parts are '' and 0."""
    x = F.col(name)
    return F.struct(
        F.regexp_extract(x, r"^([^:\s]*):", 1).alias("chrom"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r":(\d+)-", 1), F.lit("")), F.lit("999999999999")), F.lit(0)).cast("long").alias("start"),
        F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r":\d+-(\d+)", 1), F.lit("")), F.lit("999999999999")), F.lit(0)).cast("long").alias("end"),
    )


def regions(seqs: DataFrame) -> DataFrame:
    """BED-like (chrom, start, end, seq) of the headers that name a region."""
    return seqs.select("seq", region().alias("r")).select("r.chrom", "r.start", "r.end", "seq").where("chrom <> ''")


def planted(spark: SparkSession, site: str, count: int, mean: int, mutation: float, seed: int) -> DataFrame:
    """Random sequences with one mutated site each; the header tells the truth."""
    w = len(site)
    pick = lambda k: F.substring(F.lit("ACGT"), (F.floor(F.rand(k) * 4) + 1).cast("int"), F.lit(1))
    base = spark.range(count).select(F.col("id").alias("seq"), (F.lit(w) + F.floor(F.rand(seed) * 2 * mean)).cast("int").alias("n"))
    chars = base.select("seq", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("b", pick(seed + 1))
    text = chars.groupBy("seq", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]), "").alias("bg"))
    word = F.concat(*[F.when(F.rand(seed + 10 + i) < mutation, pick(seed + 50 + i)).otherwise(F.lit(b)) for i, b in enumerate(site)])
    placed = text.select("seq", "bg", "n", word.alias("site"), (F.rand(seed + 2) < 0.5).alias("rc"), F.floor(F.rand(seed + 3) * (F.col("n") - w + 1)).cast("int").alias("pos"))
    own = F.when(F.col("rc"), dna.reverse_complement(F.col("site"))).otherwise(F.col("site"))
    s = F.concat(F.substring("bg", F.lit(1), F.col("pos")), own, F.expr(f"substring(bg, pos + {w} + 1)"))
    name = F.format_string("seq %d site %s at position %6d (%sreverse complement)", "seq", "site", "pos", F.when(F.col("rc"), "").otherwise("not "))
    return placed.select("seq", name.alias("name"), s.alias("s"))


def planted_truth(seqs: DataFrame) -> DataFrame:
    """(seq, site, pos, rev_comp) of all sites that headers tell."""
    pattern = r"site ([ACGT]+) at position +(\d+) \((not )?reverse complement\)"
    found = F.explode(F.regexp_extract_all("name", F.lit(f"({pattern})"), F.lit(1))).alias("t")
    get = lambda i: F.regexp_extract("t", pattern, i)
    return seqs.select("seq", found).select("seq", get(1).alias("site"), get(2).cast("int").alias("pos"), (get(3) == "").alias("rev_comp"))
