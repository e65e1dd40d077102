"""The pipeline's stages on odd rows and on an empty table."""

import random
from collections import Counter

import corpus_pipeline
from helixframe.llm.common import saved
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def test_odd_rows(spark):
    base = spark.read.parquet(f"{D}/documents.parquet").limit(60).collect()
    rng = random.Random(3)
    rows = [tuple(r) for r in base]
    rows += [rows[0], rows[0], (None, rows[1][1], "en", None, 5), (rows[2][0], "another text under a used id, " + " ".join(rng.choice(rows[3][1].split()) for _ in range(80)), "en", "src0", 9)]
    rows += [(9001, None, "en", "src0", None), (9002, "", None, "src1", 0), (9003, "... 12 !!", "en", None, 9), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in ("score", "size", "key", "taken", "shard")})
    names, left = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left.append(saved(stage(spark, left[-1], D)))
        assert left[-1].columns == names
    first = left[1].collect()
    assert all(any(c.isalpha() for c in r["text"]) for r in first) and {9001, 9002, 9003} & {r["doc_id"] for r in first} == set()
    second = Counter((r["doc_id"], r["text"]) for r in left[2].collect())
    assert all(n == 1 for n in second.values())
    third = {(r["doc_id"], r["text"]) for r in left[3].collect()}
    assert third <= set(second) and all((r["doc_id"], r["text"]) in third for r in left[4].collect())
    out = corpus_pipeline.STAGES[-1][1](spark, left[4], D)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in left[4].collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0
