"""Files of scan results, sequence lengths, spacings and site lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from . import fasta

OCCURRENCES = "motif string, w string, seq long, pos int, strand string, Z double, score int, pvalue double"


def read_occurrences(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Eight comma-separated fields; lines with # are comments; by (seq, pos)."""
    out = spark.read.schema(OCCURRENCES.replace("score int", "score double")).option("comment", "#").option("mode", "FAILFAST").csv(path).withColumn("score", F.col("score").cast("int"))
    return out.orderBy("seq", "pos") if ordered else out


def write_occurrences(sites: DataFrame, path: str) -> None:
    sites.select("motif", "w", "seq", "pos", "strand", F.format_string("%f", "Z"), "score", F.format_string("%g", "pvalue")).write.csv(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(seq, length, name): the order of lines is the number of the sequence."""
    raw = spark.read.schema("length int, name string").option("comment", "#").csv(path).select("length", "name", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("block"))
    return fasta.numbered(raw, "seq").select("seq", "length", "name")


def write_lengths(seqs: DataFrame, path: str) -> None:
    seqs.orderBy("seq").select(F.length("s"), "name").write.csv(path)


def unmatched(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """Sites whose sequence is not listed."""
    return sites.join(lengths, "seq", "left_anti")


def bed(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(chrom, start, end, name, score, strand): score is 1000 * Z."""
    names = seqs.select("seq", "name")
    return sites.join(names, "seq").select(F.col("name").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + F.length("w")).alias("end"), F.col("motif").alias("name"), F.floor(1000 * F.col("Z")).cast("int").alias("score"), "strand")


def write_bed(sites: DataFrame, seqs: DataFrame, path: str) -> None:
    bed(sites, seqs).write.option("sep", "\t").csv(path)


def cisml(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(motif, xml): a pattern element for each motif; ends inclusive, ends swapped on the reverse strand."""
    stop = F.col("pos") + F.length("w") - 1
    a, b = F.when(F.col("strand") == "+", F.col("pos")).otherwise(stop), F.when(F.col("strand") == "+", stop).otherwise(F.col("pos"))
    one = sites.withColumn("x", F.format_string('<matched-element start="%d" stop="%d" score="%f"><sequence>%s</sequence></matched-element>', a, b, "Z", "w")).join(seqs.select("seq", "name"), "seq")
    by_seq = one.groupBy("motif", "seq", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "strand", "x"))), lambda s: s["x"]), "").alias("x"))
    wrapped = by_seq.withColumn("x", F.format_string('<scanned-sequence accession="%s" name="%s">%s</scanned-sequence>', "name", "name", "x"))
    return wrapped.groupBy("motif").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "x"))), lambda s: s["x"]), "").alias("x")).select("motif", F.format_string('<pattern accession="%s" name="%s">%s</pattern>', "motif", "motif", "x").alias("xml"))


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    """Sequence-centric CSV; the header's leading '# ' is dropped."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("# "))


def write_wide(wide: DataFrame, path: str) -> None:
    wide.write.option("header", True).csv(path)


def read_spacings(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``PRIMARY SECONDARY S|C U|D distance``; anything else is an error."""
    parts = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')").select(F.split(F.trim("value"), r"\s+").alias("p"), "value")
    good = (F.size("p") == 5) & F.get("p", F.lit(2)).isin("S", "C") & F.get("p", F.lit(3)).isin("U", "D")
    p = lambda i: F.when(good, F.get("p", F.lit(i))).otherwise(F.raise_error(F.concat(F.lit("not a spacing: "), "value")))
    return parts.select(p(0).alias("primary"), p(1).alias("secondary"), (p(2) == "S").alias("same_strand"), (p(3) == "U").alias("upstream"), p(4).cast("int").alias("distance"))


def render_spacings(spacings: DataFrame) -> DataFrame:
    return spacings.select(F.format_string("%s %s %s %s %d", "primary", "secondary", F.when(F.col("same_strand"), "S").otherwise("C"), F.when(F.col("upstream"), "U").otherwise("D"), "distance").alias("value"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace table: primary secondary seq pos strand."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("primary"), p[1].alias("secondary"), p[2].cast("long").alias("seq"), p[3].cast("int").alias("pos"), p[4].alias("strand"))


def sites_text(sites: DataFrame, consensus: str) -> DataFrame:
    """Lines W-mer,Z,p,strand,Hamming,seq,offset."""
    word = F.when(F.col("strand") == "+", F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    return sites.select(F.format_string("%s,%f,%g,%s,%d,%d,%d", word, "Z", "pvalue", "strand", dna.hamming(word, F.lit(consensus), len(consensus)), "seq", "pos").alias("value"))


def pair_fasta(spacings: DataFrame, seqs: DataFrame) -> DataFrame:
    """Name and bases [start, end) of found pairs."""
    return spacings.join(seqs, "seq").select(F.format_string("%s:%d-%d %s %s", seqs["name"], "start", "end", "primary", "secondary").alias("name"), F.substring("s", F.col("start") + 1, F.col("end") - F.col("start")).alias("s"))


def site_counts(sites: DataFrame) -> DataFrame:
    """(col, base, n): aligned sites of one motif (column o), a cell for each position and base."""
    return sites.select(F.posexplode(F.split("o", "")).alias("col", "base")).where("base <> ''").groupBy("col", "base").agg(F.count("*").alias("n"))


def from_ends(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, from_end, site): positions counted back from the sequence's end, negative."""
    return sites.join(seqs, "seq").select("name", (F.col("pos") - F.length("s")).alias("from_end"), F.col("w").alias("site"))


def one_based(sites: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, first, last): positions from 1, ends inclusive."""
    return sites.join(seqs, "seq").select("name", (F.col("pos") + 1).alias("first"), (F.col("pos") + F.length("w")).alias("last"))
