"""A corpus pipeline of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again as the next one's ``docs``.  All but the last return the columns of ``documents``; the
last returns, for each document that the mix holds, the shard where it is.

Edge cases: null and empty texts have no language and go at the first stage; of repeated rows one stays after the
second; rows whose ids are null or used twice are told apart by their text; other columns, whatever their names,
are carried; an empty table gives empty stages.  Very long texts are whole at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, langid, mixing, ngram_join, sharding
from helixframe.llm.common import saved, table

STAGES = [
    ("language_id", langid.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("mix", mixing.stage),
    ("shard", sharding.stage),
]

#: The trained classifier has no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
