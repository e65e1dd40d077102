"""The scan as a stream: it has no state, so the batch expressions work record by record."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.pssm import Motif, sum_over
from ..operators.scan import LAMBDA, THRESHOLD


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of FASTA files that arrive in ``folder``: (name, s)."""
    raw = spark.readStream.option("lineSep", "\n>").text(folder).select(F.regexp_replace("value", "^>", "").alias("v"))
    return raw.select(F.trim(F.substring_index("v", "\n", 1)).alias("name"), dna.normalise(F.expr("substring(v, locate('\n', v) + 1)")).alias("s"))


def scan(records: DataFrame, motif: Motif, freqs: list[float], lam: float = LAMBDA, threshold: float = THRESHOLD) -> DataFrame:
    """(name, motif, w, pos, strand, Z) against base frequencies."""
    logp = motif.log()
    ratio = logp - [[math.log(f) for f in freqs]] * motif.width
    back = logp[::-1, ::-1] - [[math.log(f) for f in freqs]] * motif.width
    prior = math.log(lam / (1 - lam))
    words = records.select("name", F.posexplode(dna.words(F.col("s"), motif.width)).alias("pos", "w")).where(~dna.has_unknown(F.col("w")))
    z = F.explode(F.array(*[F.struct(F.lit(s).alias("strand"), dna.sigmoid(F.lit(prior) + sum_over(F.col("w"), m)).alias("Z")) for s, m in (("+", ratio), ("-", back))]))
    return words.select("name", "w", "pos", z.alias("x")).select("name", F.lit(motif.name).alias("motif"), "w", "pos", "x.strand", "x.Z").where(F.col("Z") >= threshold)
