"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the training texts into index segments: one row for each
few megabytes of text with a sorted term dictionary and, for each term, the
positions where it stands.  Segments hold whole documents, so the index is written
once, without a shuffle, and every query is answered segment by segment.
``search`` looks up a phrase from its rarest term: the posting list of that term,
shifted by the term's offset, gives the possible starts, and the lists of the other
terms, rarest first, are intersected with them.  Phrases are arrays of at most ``QUERY_BYTES`` of
benchmark text (one item at least); a larger benchmark is searched block after block, each
broadcast given back before the next, and the documents' answers are merged.  So neither the driver
nor an executor holds more than a block, some 100 bytes for each of its words.

Terms are 64-bit hashes of lower-cased words (a phrase is found by ten agreeing
hashes).  Edge cases: a null or wordless text has no words and no hits; a null or
wordless benchmark text has no window; repeated rows are judged each; an empty
benchmark leaves every document clean; columns besides id and text are ignored,
whatever their names.  A very long text is a segment of its own, with some 60 bytes of memory a word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import kernel
from .common import plain, saved, table
from .pack import dump, load

WINDOW = 10
#: Benchmark text that one broadcast block of phrases holds at most.
QUERY_BYTES = 2 << 20
#: Free positions between the documents of a segment; a proximity search reaches less far.
GAP = 64
#: Candidate starts that are checked at a time.
CHUNK = 1 << 20

_SEGMENT = "segment string, ids array<{kind}>, first binary, n_words binary, terms binary, counts binary, postings binary"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: segments of term dictionary and positional postings."""
    kind = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in kernel.slices(batch.column(1)):
                h, offs = kernel.words(batch.column(1).slice(a, b - a), kernel.ALNUM)
                n = np.diff(offs)
                first = offs[:-1] + GAP * np.arange(len(n))
                pos = np.arange(len(h)) + GAP * np.repeat(np.arange(len(n)), n)
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                counts = np.diff(np.append(new, len(h)))
                yield pa.record_batch({
                    "segment": [uuid.uuid4().hex], "ids": pa.array([batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    "first": [dump(first.astype(np.int32))], "n_words": [dump(n.astype(np.int32))],
                    "terms": [dump(h[new], rising=True)], "counts": [dump(counts.astype(np.int32))], "postings": [dump(pos.astype(np.int32), rising=True)],
                })

    return saved(docs.mapInArrow(segments, _SEGMENT.format(kind=kind)), compression="zstd")


class Phrases:
    """Distinct windows by length, and the items that hold each."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        h, offs = kernel.words(texts, kernel.ALNUM)
        size = np.diff(offs)
        self.ids, self.groups = ids, []
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            own = np.flatnonzero(size >= n if n == window else size == n)
            item, start = kernel.runs(offs[own], size[own] - n + 1)
            item = own[item]
            name = kernel.grams(h, n)[start]
            order = np.lexsort((item, name))
            name, item, start = name[order], item[order], start[order]
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            once = new.copy()
            once[1:] |= item[1:] != item[:-1]
            words = h[start[new][:, None] + np.arange(n)]
            self.groups.append((words, item[once], np.append(np.flatnonzero(new[once]), once.sum())))


class Segment:
    """A decoded index row."""

    def __init__(self, row: dict):
        self.first, self.n = load(row["first"]).astype(np.int64), load(row["n_words"]).astype(np.int64)
        self.terms, self.counts = load(row["terms"], rising=True), load(row["counts"]).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.pos = load(row["postings"], rising=True).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) << 32 | self.pos
        self.size = int(self.first[-1] + self.n[-1] + GAP) if len(self.n) else 0

    def has(self, rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
        key = rank << 32 | pos
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (pos >= 0) & (self.keys[k] == key)

    def near(self, rank: np.ndarray, pos: np.ndarray, reach: int) -> np.ndarray:
        """Whether the term stands at most ``reach`` positions from ``pos``."""
        k = np.searchsorted(self.keys, rank << 32 | np.maximum(pos - reach, 0))
        k = np.minimum(k, len(self.keys) - 1)
        return (self.keys[k] >= (rank << 32 | np.maximum(pos - reach, 0))) & (self.keys[k] <= (rank << 32 | (pos + reach)))

    def find(self, phrases: np.ndarray, reach: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrase numbers and positions: exact starts, or with ``reach`` where the rarest term stands near all others."""
        if not len(self.terms):
            return
        rank = np.minimum(np.searchsorted(self.terms, phrases), len(self.terms) - 1)
        here = np.flatnonzero((self.terms[rank] == phrases).all(1))
        if not len(here):
            return
        rank = rank[here]
        order = np.argsort(self.counts[rank], axis=1, kind="stable")
        rare = rank[np.arange(len(here)), order[:, 0]]
        total = np.concatenate([[0], np.cumsum(self.counts[rare])])
        a = 0
        while a < len(here):
            b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
            which, at = kernel.runs(self.at[rare[a:b]], self.counts[rare[a:b]])
            which, start = which + a, self.pos[at]
            if reach < 0:
                start = start - order[which, 0]
            for k in range(1, rank.shape[1]):
                j = order[which, k]
                ok = self.has(rank[which, j], start + j) if reach < 0 else self.near(rank[which, j], start, reach)
                which, start = which[ok], start[ok]
            if reach < 0:
                which, start = which[start >= 0], start[start >= 0]
            if len(which):
                yield here[which], start
            a = b


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, slop: int = -1) -> DataFrame:
    """A row for each indexed document: id, n_words, items (with an exact window), spans hit, near_items.

    ``slop >= 0`` also reports items with a window whose words all stand, in any order, within
    ``window + slop`` words of its rarest one.
    """
    if window + max(slop, 0) >= GAP:
        raise ValueError(f"a proximity search reaches less than {GAP} words")
    spark = index.sparkSession
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES) or 1
    docs = None
    for k in range(blocks):
        got = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)).toArrow()
        held = spark.sparkContext.broadcast(Phrases(got.column("id").to_pylist(), got.column("text").combine_chunks(), window))
        found = _searched(index, held, slop)
        if blocks == 1:
            return found.select("id", "n_words", "items", "spans", "near_items")
        part = saved(found.where(F.lit(k == 0) | (F.size("spans") > 0) | (F.size("near_items") > 0)))  # the first has every document
        held.destroy()
        docs = part if docs is None else docs.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    both = docs.groupBy("segment", "k").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), flat("items"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), flat("near_items"))
    # spans in order: one that begins within the last one's reach belongs to it
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")
    merged = F.reduce("spans", none, lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["start"]), grown(a, s)).otherwise(F.concat(a, F.array(s))))
    return both.select("id", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), merged.alias("spans"), F.array_sort(F.array_distinct("near_items")).alias("near_items"))


def _searched(index: DataFrame, held: Broadcast, slop: int) -> DataFrame:
    """segment, k, id, n_words, items, spans, near_items of every indexed document, for one block of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                seg = Segment({c: batch.column(c)[row].as_py() for c in ("first", "n_words", "terms", "counts", "postings")})
                docs = len(seg.n)
                edge = np.zeros(seg.size + 1, np.int32)
                pairs, near = [set() for _ in range(docs)], [set() for _ in range(docs)]
                phrases = held.value
                for group, of, cut in phrases.groups:
                    for kind, reach in ((pairs, -1), (near, group.shape[1] + slop))[: 1 + (slop >= 0)]:
                        for which, start in seg.find(group, reach):
                            if kind is pairs:
                                np.add.at(edge, start, 1)
                                np.add.at(edge, start + group.shape[1], -1)
                            doc = np.searchsorted(seg.first, start, side="right") - 1
                            both = np.unique(doc * len(group) + which)
                            r, at = kernel.runs(cut[both % len(group)], np.diff(cut)[both % len(group)])
                            for d, i in zip((both // len(group))[r].tolist(), of[at].tolist(), strict=True):
                                kind[d].add(phrases.ids[i])
                hit = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                spans: list[list[dict]] = [[] for _ in range(docs)]
                for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                    d = int(np.searchsorted(seg.first, s, side="right")) - 1
                    spans[d].append({"start": s - int(seg.first[d]), "end": e - int(seg.first[d])})
                order = [sorted(x, key=lambda i: (i is not None, i)) for x in pairs]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("segment")[row].as_py()] * docs, pa.string()), pa.array(range(docs), pa.int32()), batch.column("ids").slice(row, 1).flatten(), pa.array(seg.n, pa.int64()),
                    pa.array(order, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([sorted(x, key=str) for x in near], pa.list_(pa.string())),
                ], names=["segment", "k", "id", "n_words", "items", "spans", "near_items"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return index.mapInArrow(run, f"segment string, k int, id {kind}, n_words long, items array<string>, spans array<struct<start:int,end:int>>, near_items array<string>")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, as digests."""
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: drops documents with a benchmark window; rows with equal ids are judged by their own text."""
    ship(spark)
    names = docs.columns
    keyed = docs.withColumn("_hf_row", F.struct(F.col("`doc_id`"), F.xxhash64("text").alias("h")))
    found = search(build_index(keyed, "_hf_row"), table(spark, sf_dir, "benchmark"))
    bad = found.where(F.size("spans") > 0).select(F.col("id.h").alias("_hf_bad"), F.col("id.doc_id").alias("_hf_doc")).distinct()
    keep = keyed.join(bad, (F.col("_hf_bad") == F.col("_hf_row.h")) & F.col("_hf_doc").eqNullSafe(F.col("_hf_row.doc_id")), "left_anti")
    return plain(keep, *names)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, len(w[k:k + 9]) AS n, array_to_string(w[k:k + 9], ' ') AS p
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM q),
win AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
        FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT win.doc_id, win.k, win.n, q.item_id FROM win JOIN q ON win.n = q.n AND win.p = q.p),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM hit) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
