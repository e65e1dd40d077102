"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of a bounded, documented sample of labelled rows
(``max_rows`` in all, drawn evenly by a hash of the id), aggregates them with a
distributed ``groupBy`` and brings ``languages x buckets`` numbers to the driver,
whose size is checked.  Scoring broadcasts that matrix; each Arrow batch is
turned into n-gram ids by numpy and scored by sparse gathers and segment sums, so
whole texts are read once and nothing is shuffled.

Edge cases: a null text, an empty one and one without any letter get ``und`` with
score 0; a null ``lang`` never trains; without any training row all is ``und``;
repeated rows are scored each; ties go to the smaller language name; columns that
the input has besides are ignored.  A very long text is handled in one piece, with some 60 bytes for each sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import kernel
from .common import plain, split_mod, table

ORDERS = (2, 3)
BUCKET_BITS = 15
#: Most labelled rows that training reads.
MAX_ROWS = 20_000
#: Most cells (languages x buckets) of the model that is broadcast.
MAX_CELLS = 16_000_000
UND = "und"
#: The pipeline rejects documents whose best language has less probability than this.
MIN_SCORE = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row starts in code points, letters a row, and for each order positions and buckets."""
    gap = " " * (max(ORDERS) - 1)
    low = [(x or "").lower() for x in texts]
    sizes = np.array([len(x) + len(gap) for x in low], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    # the gap stands before each text, so that what begins in it is that text's
    code = np.frombuffer((gap + gap.join(low) + gap + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32)).astype(np.uint32)
    n = int(starts[-1])
    # a gram counts where a letter is its first or, after a space, its second sign
    at = np.flatnonzero(letter[:n] | letter[1 : n + 1])
    found = []
    h = np.full(n, np.uint32(0x9E3779B1), dtype=np.uint32)
    for j in range(max(ORDERS)):
        h ^= code[j : n + j]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if j + 1 in ORDERS:
            k = ORDERS.index(j + 1)
            found.append((at, (h >> np.uint32(32 - BUCKET_BITS))[at].astype(np.int64) + (k << BUCKET_BITS)))
    letters = np.add.reduceat(letter[:n], starts[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return starts, letters, found


WIDTH = len(ORDERS) << BUCKET_BITS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for a, b in kernel.slices(batch.column(0), 1 << 20):
            part = batch.slice(a, b - a)
            names = np.array(part.column(1).to_pylist(), dtype=object)
            starts, _, found = _grams(part.column(0).to_pylist())
            for lang in sorted(set(names)):
                own = names == lang
                for at, bucket in found:
                    row = np.searchsorted(starts, at, side="right") - 1
                    total.setdefault(lang, np.zeros(WIDTH, np.int64))
                    total[lang] += np.bincount(bucket[own[row]], minlength=WIDTH)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Language names in order, and log-probabilities ``[language, bucket]``, centred over languages."""
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h")).where("text IS NOT NULL AND lang IS NOT NULL")
    per_lang = rows.groupBy("lang").count().limit(MAX_CELLS // WIDTH + 1).collect()
    names = sorted(r["lang"] for r in per_lang)
    if len(names) * WIDTH > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS // WIDTH} languages; the model would be too large to broadcast")
    if not names:
        return [], np.zeros((0, WIDTH))
    share = max(1, max_rows // len(names))
    # an even share of every language: the rows with the smallest hashes, about ``share`` of them
    keep = F.lit(False)
    for r in per_lang:
        part = min(1.0, share / r["count"])
        keep = keep | ((F.col("lang") == F.lit(r["lang"])) & (F.pmod(F.col("h"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)) + 1)))
    counts = (
        rows.where(keep).select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    n = np.zeros((WIDTH, len(names)))
    col = {x: i for i, x in enumerate(names)}
    n[counts.column("bucket").to_numpy(), [col[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    logp = np.empty_like(n)
    for k in range(len(ORDERS)):  # one multinomial for each order, add-one smoothing
        part = slice(k << BUCKET_BITS, (k + 1) << BUCKET_BITS)
        logp[part] = np.log(n[part] + 0.5) - np.log(n[part].sum(0) + 0.5 * (1 << BUCKET_BITS))
    return names, np.ascontiguousarray((logp - logp.mean(1, keepdims=True)).T)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of equally named columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names_in = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = plain(docs, *names_in)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight = held.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in kernel.slices(texts, 1 << 20):
                part = batch.slice(a, b - a)
                best, p = np.zeros(b - a, np.int64), np.zeros(b - a)
                starts, letters, found = _grams(part.column(batch.schema.get_field_index(text)).to_pylist())
                if names:
                    total = np.zeros((b - a, len(names)))
                    for at, bucket in found:
                        cut = np.searchsorted(at, starts)
                        full = np.flatnonzero(np.diff(cut))
                        if len(full):
                            for col, w in enumerate(weight):
                                total[full, col] += np.add.reduceat(w[bucket], cut[full])
                    best = total.argmax(1)
                    e = np.exp(total - total.max(1, keepdims=True))
                    p = e.max(1) / e.sum(1)
                some = (letters > 0) & bool(names)
                pred = [names[i] if ok else UND for i, ok in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(np.where(some, p, 0.0))], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt where crc32(doc_id) mod 3 is not 1."""
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = train(docs.where(split_mod(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (split_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drops documents of no recognisable language; the columns stay as they are."""
    ship(spark)
    model = train(docs)
    out = predict(docs, model)
    return plain(out.where((F.col("lang_pred") != UND) & (F.col("score") >= MIN_SCORE)), *docs.columns)
