"""Sequence tables, tiles, words and window counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna

#: Bases of a tile; a chromosome becomes many rows before its words are exploded.
TILE = 4096
#: Bases of a chunk of :func:`short_counts`: 4 ** 8 distinct ones and those with unknown bases.
CHUNK = 8


def from_documents(docs: DataFrame) -> DataFrame:
    """(seq, name, s): the DNA view of a table of documents."""
    return docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("name"), dna.from_text(F.col("text")).alias("s"))


def globalise(seqs: DataFrame) -> DataFrame:
    """Adds length and gstart, the offset in the concatenation of all sequences by seq.

    Two levels: sums of ranges of sequences first, so no task orders all sequences.
    """
    rows = seqs.withColumn("length", F.length("s").cast("long"))
    spread = rows.select("seq", "length").withColumn("block", F.floor(F.col("seq") / 1024))
    blocks = spread.groupBy("block").agg(F.sum("length").alias("n"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy("block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = spread.withColumn("own", F.coalesce(F.sum("length").over(inner), F.lit(0))).join(start, "block").select("seq", (F.col("base") + F.col("own")).alias("gstart"))
    return rows.join(placed, "seq")


def localise(positions: DataFrame, seqs: DataFrame) -> DataFrame:
    """Global positions (gpos) to (gpos, seq, pos); ``seqs`` with gstart and length."""
    ranges = seqs.select("seq", "gstart", "length").where("length > 0")
    step = F.lit(65536)
    binned = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gstart") / step), F.floor((F.col("gstart") + F.col("length") - 1) / step))))
    return (
        positions.withColumn("bin", F.floor(F.col("gpos") / step)).join(binned, "bin").where("gpos >= gstart AND gpos < gstart + length")
        .select("gpos", "seq", (F.col("gpos") - F.col("gstart")).alias("pos"))
    )


def tiles(seqs: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """(seq, offset, s): pieces of at most ``tile`` windows with ``width - 1`` bases of overlap."""
    last = F.length("s") - width
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(tile))).otherwise(F.array().cast("array<int>"))
    return seqs.select("seq", "s", F.explode(starts).alias("offset")).select("seq", "offset", F.substring("s", F.col("offset") + 1, F.lit(tile + width - 1)).alias("s"))


def windows(seqs: DataFrame, width: int, known: bool = True) -> DataFrame:
    """(seq, pos, w): every window; ``known`` leaves out those with an unknown base."""
    out = tiles(seqs, width).select("seq", "offset", F.posexplode(dna.words(F.col("s"), width)).alias("i", "w")).select("seq", (F.col("offset") + F.col("i")).alias("pos"), "w")
    return out.where(~dna.has_unknown(F.col("w"))) if known else out


def all_words(spark: SparkSession, width: int) -> DataFrame:
    """(w): the 4 ** width words over ACGT."""
    base = lambda i: F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    return spark.range(4**width).select(F.concat(*[base(i) for i in range(width)]).alias("w"))


def short_counts(seqs: DataFrame, width: int) -> DataFrame:
    """(w, n): the distinct words, unknown bases included, of a small width.

    Chunks of ``CHUNK`` bases, which share ``width - 1``, are counted map-side; only distinct ones are cut into words.
    """
    size = max(CHUNK, width)
    chunk = F.regexp_extract_all("s", F.lit(f"(?=(.{{1,{size}}})).{{1,{size - width + 1}}}"), F.lit(1))
    chunks = tiles(seqs, width).select(F.explode(chunk).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return chunks.select("n", F.explode(dna.words(F.col("c"), width)).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))


def word_counts(seqs: DataFrame, width: int) -> DataFrame:
    """(w, n): the distinct known words, counted map-side first."""
    return windows(seqs, width).groupBy("w").agg(F.count("*").alias("n"))


def canonical_counts(seqs: DataFrame, width: int) -> DataFrame:
    return word_counts(seqs, width).groupBy(dna.canonical(F.col("w")).alias("w")).agg(F.sum("n").alias("n"))


def composition(seqs: DataFrame) -> DataFrame:
    """(base, n), base in A, C, G, T, N; from lengths, nothing is exploded."""
    count = lambda b: F.coalesce(F.sum(F.length("s") - F.length(F.replace("s", F.lit(b)))), F.lit(0)).cast("long").alias(b)
    one = seqs.agg(*[count(b) for b in "ACGTN"])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGTN"])).alias("x")).select("x.base", "x.n")


def runs(seqs: DataFrame) -> DataFrame:
    """(seq, start, end, known): maximal runs of known and of unknown bases."""
    found = seqs.select("seq", F.regexp_extract_all("s", F.lit("([ACGT]+|[^ACGT]+)"), F.lit(1)).alias("r"))
    cut = found.select("seq", F.posexplode("r").alias("i", "run")).withColumn("size", F.length("run"))
    before = W.partitionBy("seq").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    return cut.withColumn("start", start).select("seq", "start", (F.col("start") + F.col("size")).alias("end"), (~dna.has_unknown(F.col("run"))).alias("known"))


def known_window_counts(seqs: DataFrame, most: int) -> DataFrame:
    """(width, n) for widths 1 to ``most``, from the lengths of known runs."""
    sizes = seqs.select(F.explode(F.regexp_extract_all("s", F.lit("([ACGT]+)"), F.lit(1))).alias("r")).groupBy(F.length("r").alias("size")).agg(F.count("*").alias("k"))
    widths = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("width")
    return sizes.select("size", "k", widths).groupBy("width").agg(F.sum(F.greatest(F.lit(0), F.col("size") - F.col("width") + 1) * F.col("k")).alias("n"))


def start_counts(seqs: DataFrame, widths: list[int]) -> DataFrame:
    """(width, n): distinct canonical words of each width; the words of the largest give the shorter ones."""
    out = None
    for w in widths:
        part = word_counts(seqs, w).agg(F.count_distinct(dna.canonical(F.col("w"))).alias("n")).select(F.lit(w).alias("width"), "n")
        out = part if out is None else out.unionByName(part)
    return out
