"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram automaton.  Its states are the contexts (words, word pairs)
that training has seen, plus the empty one; a seen n-gram is an arc that carries its
smoothed log-probability and leads to the longest suffix that is a state; every other
word takes the failure arc to the next shorter context, whose weight is the backoff
mass.  Smoothing is hierarchical (each order's distribution is the Dirichlet prior,
of mass ``MU[order]``, of the next), so all weights follow from the counts of an n-gram and of
its context, and every state's distribution sums to one.  The empty context is the
add-one unigram model that also gives ``base_score``.

The input is read once: a block of documents (some megabytes of text) is stored as its tokens, in buckets by its name.
Each block reduces its n-grams to sorted distinct hashes (words 64 bits, pairs and triples ``KEY_BITS``,
whatever the corpus's size) and sends them, dealt by hash range, as packed arrays with its
training counts; the range's owner sums them up and answers each block with what others
add to the n-grams it asked for.  So a block gets its part of the automaton
(:class:`Block`): states, arcs with weights and targets, failure arcs.  It is walked from left to right,
many texts in step: each carries its state, follows an arc or failure arcs, and adds up their
weights.  Long texts are walked in pieces, each from the state that the words before it lead
to.  No task ever holds the model, and no key is hot: a block sends each n-gram once.  A block
sends one row to each range, as a shuffle's map task does; both are bounded by memory, not by the corpus.

Edge cases: a null or empty text is one end token; repeated rows are counted and
scored each; with no training rows N and V are 0; columns besides id and text, and
ids that are null or equal, do no harm.  A very long text is a block of its own, with some 150 bytes of memory a word.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import dealt, duck_crc, partitions, split_mod, table
from .pack import dump, load

#: Prior mass of the next shorter context, for word pairs and triples.
MU = {2: 1000.0, 3: 4.0}
#: Text of a block of documents.
BLOCK_BYTES = 8 << 20
#: Bits of a pair's or triple's hash: of 10**12 of them about one in 70,000 shares its hash with another.
KEY_BITS = 56
#: Decimals of the query's scores.
DIGITS = 6
#: Tokens of a text that are walked in one piece.
PIECE = 256

U = np.uint64
END, BEGIN = U(0x51ED270B9F1A3C4D), U(0xA0761D6478BD642F)


class Automaton:
    """The automaton over plain tokens; the reference form, for small corpora and tests."""

    def __init__(self, texts: Iterable[list[str]]):
        self.count: Counter = Counter()
        self.context: Counter = Counter()
        for words in texts:
            line = ["<s>", *words, "</s>"]
            for i in range(1, len(line)):
                for k in (0, 1, 2):
                    if i - k >= 0:
                        self.count[tuple(line[i - k : i + 1])] += 1
                        self.context[tuple(line[i - k : i])] += 1
        self.n = self.context[()]
        self.v = sum(len(x) == 1 for x in self.count)

    def arc(self, state: tuple[str, ...], word: str) -> float | None:
        """Log10 weight of the arc, if there is one."""
        if not state:
            return math.log10((self.count[(word,)] + 1) / (self.n + self.v + 1))
        if not self.count[(*state, word)]:
            return None
        lower = self.arc(state[1:], word)
        if lower is None:  # a shorter n-gram of a seen one has been seen
            raise AssertionError(state)
        mu = MU[len(state) + 1]
        return math.log10((self.count[(*state, word)] + mu * 10**lower) / (self.context[state] + mu))

    def failure(self, state: tuple[str, ...]) -> float:
        mu = MU[len(state) + 1]
        return math.log10(mu / (self.context[state] + mu))

    def score(self, words: list[str]) -> float:
        """One walk: the state is carried, arcs and failure arcs add up."""
        state, total = (("<s>",) if self.context[("<s>",)] else ()), 0.0
        for word in [*words, "</s>"]:
            at = state
            while (w := self.arc(at, word)) is None:
                total += self.failure(at)
                at = at[1:]
            total += w
            state = (*at, word)[-2:]
            while state and not self.context[state]:
                state = state[1:]
        return total


class Ngrams:
    """A block's distinct words, pairs and triples, and which of them ends at each token."""

    def __init__(self, vocabulary: np.ndarray, at: np.ndarray, size: np.ndarray):
        """``vocabulary``: sorted hashes; ``at``: the word of each token; ``size``: tokens of each text, the end included."""
        self.cut = np.concatenate([[0], np.cumsum(size)])
        self.head = np.zeros(len(at), bool)  # a text's first token: it ends no triple
        self.head[self.cut[:-1]] = True
        t, drop = vocabulary[at], U(64 - KEY_BITS)
        before = np.empty_like(t)
        before[1:] = t[:-1]
        before[self.head] = BEGIN
        two = kernel.mix(before * U(0xD6E8FEB86659FD93) + t)
        three = np.zeros_like(t)
        three[1:] = kernel.mix(two[:-1] * U(0xA24BAED4963EE407) + t[1:])
        self.keys, self.ids, self.first = [vocabulary], [at], [None]
        for key in (two >> drop, np.where(self.head, U(0), three >> drop)):
            order = np.argsort(key)
            s = key[order]
            new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(new) - 1
            self.keys.append(s[new])
            self.ids.append(number)
            self.first.append(order[new])  # a token where the n-gram stands

    def counts(self, learn: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram stands where ``learn`` holds."""
        on = [learn, learn, learn & ~self.head]
        return [np.bincount(i, x, len(k)).astype(np.int64) for k, i, x in zip(self.keys, self.ids, on, strict=True)]


class Block:
    """A block's part of the automaton.

    States: -1 is the empty context; word w is state w, the text's begin is state V; the pair p is
    state V + 1 + p.  Arcs are numbered like the n-grams they read.
    """

    def __init__(self, g: Ngrams, count: list[np.ndarray], n: int, v: int):
        words, pairs, triples = (x.astype(np.float64) for x in count)
        self.g, self.size = g, len(words)
        end = int(np.searchsorted(g.keys[0], END))
        context = np.append(words, words[end] if len(words) else 0.0)  # begins are as many as ends
        # failure arcs: weight and target of every state that training has seen
        with np.errstate(divide="ignore"):
            self.fail = np.concatenate([np.log10(MU[2] / (context + MU[2])), np.log10(MU[3] / (pairs + MU[3]))])
        tail = g.ids[0][g.first[1]] if len(pairs) else np.zeros(0, np.int64)
        self.short = np.concatenate([np.full(self.size + 1, -1), np.where(words[tail] > 0, tail, -1)])
        # arcs: there is one where training has seen the n-gram (of a single word always)
        base = (words + 1) / (n + v + 1)
        lead = np.where(g.head, self.size, np.concatenate([[0], g.ids[0][:-1]]) if len(g.head) else 0)
        p2 = (pairs + MU[2] * base[tail]) / (context[lead[g.first[1]]] + MU[2])
        at = g.first[2]
        p3 = (triples + MU[3] * p2[g.ids[1][at]]) / (pairs[g.ids[1][np.maximum(at - 1, 0)]] + MU[3])
        self.seen = [words > 0, pairs > 0, triples > 0]
        self.arc = [np.log10(base), np.log10(p2), np.log10(p3)]
        self.begin = self.size if context[self.size] > 0 else -1

    def after(self, i: np.ndarray) -> np.ndarray:
        """The state that token ``i`` and what stands before it lead to: the longest suffix that is one."""
        word, pair = self.g.ids[0][i], self.g.ids[1][i]
        return np.where(self.seen[1][pair], self.size + 1 + pair, np.where(self.seen[0][word], word, -1))

    def walk(self) -> np.ndarray:
        """Log-probability of each text."""
        cut = self.g.cut
        n = -(-np.diff(cut) // PIECE)
        text, k = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = cut[:-1][text] + k * PIECE
        size = np.minimum(cut[1:][text] - start, PIECE)
        order = np.argsort(-size, kind="stable")
        text, start, size, k = text[order], start[order], size[order], k[order]
        state = np.where(k == 0, self.begin, self.after(np.maximum(start - 1, 0)))
        total = np.zeros(len(text), np.longdouble)
        live = np.searchsorted(-size, -np.arange(PIECE), side="left")  # pieces that have a token at this step
        word, pair, triple = self.g.ids
        for step in range(int(size.max()) if len(size) else 0):
            m = int(live[step])
            i, s, w = start[:m] + step, state[:m], np.zeros(m)
            open_ = np.ones(m, bool)
            for level, arc in ((2, triple), (1, pair)):
                here = open_ & ((s > self.size) if level == 2 else (s >= 0))
                hit = here & self.seen[level][arc[i]]
                w[hit] += self.arc[level][arc[i[hit]]]
                open_ &= ~hit
                miss = here & ~hit
                w[miss] += self.fail[s[miss]]
                s = np.where(miss, self.short[s], s)
            w[open_] += self.arc[0][word[i[open_]]]
            total[:m] += w
            state[:m] = self.after(i)
        out = np.zeros(len(n), np.longdouble)
        np.add.at(out, text, total)
        return out.astype(np.float64)


_ROW = "bucket long, block string, n long, v long, a binary, b binary, c binary, d binary, e binary, f binary"
_NAMES = ["bucket", "block", "n", "v", "a", "b", "c", "d", "e", "f"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, train, text to a row for each block: ids and train flags, tokens of each text, words of the tokens, vocabulary."""
    for batch in batches:
        for a, b in kernel.slices(batch.column(2), BLOCK_BYTES):
            part = batch.slice(a, b - a)
            h, offs = kernel.words(part.column(2), kernel.NONSPACE)
            size = np.diff(offs) + 1
            t = np.empty(len(h) + len(size), dtype=U)
            ends = np.zeros(len(t), bool)
            ends[np.cumsum(size) - 1] = True
            t[ends], t[~ends] = END, h
            vocabulary, at, many = np.unique(t, return_inverse=True, return_counts=True)
            # frequent words first, so that codes are short; by hash among words about as frequent
            order = np.lexsort((vocabulary, -np.frexp(many)[1]))
            code = np.empty(len(order), np.uint32)
            code[order] = np.arange(len(order), dtype=np.uint32)
            vocabulary, at = vocabulary[order], code[at]
            sink = pa.BufferOutputStream()
            head = pa.record_batch([part.column(0), part.column(1)], names=["id", "train"])
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            yield _batch([(-1, uuid.uuid4().hex, 0, 0, sink.getvalue().to_pybytes(), dump(size.astype(np.int32)), dump(at), dump(vocabulary, rising=True), None, None)])


def _open(row: dict) -> tuple[pa.Table, Ngrams, list[np.ndarray]]:
    """A stored block: its ids and train flags, n-grams, and their counts in its own training texts."""
    head = pa.ipc.open_stream(row["a"]).read_all()
    size = load(row["b"]).astype(np.int64)
    vocabulary = load(row["d"], rising=True)
    order = np.argsort(vocabulary)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    g = Ngrams(vocabulary[order], rank[load(row["c"])], size)
    return head, g, g.counts(np.repeat(head.column("train").to_numpy(), size))


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (as id), train, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from the rows where ``train`` holds.
    """
    spark = docs.sparkSession
    ranges = max(1, partitions(spark))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    edges = [np.array([(i << bits) // ranges for i in range(1, ranges)], dtype=U) for bits in (64, KEY_BITS, KEY_BITS)]
    blocks = dealt(rows.mapInArrow(_blocks, _ROW), "block", ranges)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                _, g, counts = _open(one)
                cols: list[list[bytes]] = []
                for k, n, e in zip(g.keys, counts, edges, strict=True):
                    c = np.concatenate([[0], np.searchsorted(k, e), [len(k)]])
                    cols.append([dump(k[c[r] : c[r + 1]], rising=True) for r in range(ranges)])
                    cols.append([dump(n[c[r] : c[r + 1]].astype(np.uint32)) for r in range(ranges)])
                yield _batch([(r, one["block"], 0, 0, *(x[r] for x in cols)) for r in range(ranges)])

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        names = group.column("block").to_pylist()
        n = v = 0
        cols = []
        for order in range(3):
            keys = [load(x, rising=True) for x in group.column(4 + 2 * order).to_pylist()]
            sizes = np.cumsum([len(x) for x in keys])[:-1]
            k, c = np.concatenate(keys), np.concatenate([load(x) for x in group.column(5 + 2 * order).to_pylist()])
            del keys
            by = np.argsort(k)
            s = k[by]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            total = np.add.reduceat(c[by], new, dtype=np.int64) if len(s) else np.zeros(0, np.int64)
            if order == 0:
                n, v = int(total.sum()), int((total > 0).sum())
            more = np.empty(len(s), np.uint32)
            more[by] = np.repeat(total, np.diff(np.append(new, len(s)))).astype(np.uint32)
            more -= c  # what other blocks add
            cols.append([dump(x) for x in np.split(more, sizes)])
        return pa.Table.from_batches([_batch([(key[0].as_py(), names[i], n, v, cols[0][i], cols[1][i], cols[2][i], None, None, None) for i in range(len(names))])])

    def walk(tail: pa.Table, block: pa.Table) -> pa.Table:
        tail = tail.sort_by("bucket")
        head, g, counts = _open(block.to_pylist()[0])
        # every range answers every block, so the ranges' sums are the corpus's
        n, v = sum(tail.column("n").to_pylist()), sum(tail.column("v").to_pylist())
        counts = [c + np.concatenate([load(x) for x in tail.column(4 + k).to_pylist()]) for k, c in enumerate(counts)]
        model = Block(g, counts, n, v)
        size = np.diff(g.cut)
        add = lambda x: np.add.reduceat(x[g.ids[0]], g.cut[:-1])  # noqa: E731  every text has its end token
        base = add(model.arc[0].astype(np.longdouble)).astype(np.float64)
        sums = {"n_tokens": size, "n_known": add(model.seen[0].astype(np.int64)), "train_tokens": np.full(len(size), n), "base_score": base, "score": model.walk()}
        return pa.table({"id": head.column("id"), "train": head.column("train")} | {k: pa.array(x) for k, x in sums.items()})

    answers = blocks.mapInArrow(ask, _ROW).groupBy("bucket").applyInArrow(answer, _ROW)
    # the blocks lie in buckets by name, so only the answers are shuffled
    return answers.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(walk, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by the model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, split_mod(F.col("doc_id"), 7) != 2)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", *[F.round(c, DIGITS).alias(c) for c in ("base_score", "score")])


#: The interpolated form of the same model.
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {duck_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS w FROM documents),
t AS MATERIALIZED (SELECT r, held_out, unnest(w) AS c, unnest(list_prepend(' begin', w[:-2])) AS b, unnest(list_concat([NULL, ' begin'], w[:-3])[:len(w)]) AS a FROM d),
u1 AS MATERIALIZED (SELECT c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1),
u2 AS MATERIALIZED (SELECT b, c, count(*) AS n FROM t WHERE NOT held_out GROUP BY 1, 2),
u3 AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT coalesce(sum(n), 0)::BIGINT AS n, count(*) AS v FROM u1),
p AS (SELECT t.r, coalesce(u1.n, 0) AS c1, (coalesce(u1.n, 0) + 1) / (k.n + k.v + 1) AS base,
    (coalesce(u2.n, 0) + {MU[2]} * (coalesce(u1.n, 0) + 1) / (k.n + k.v + 1)) / (coalesce(h1.n, 0) + {MU[2]}) AS p2, coalesce(u3.n, 0) AS c3, coalesce(h2.n, 0) AS h2, k.n
  FROM t CROSS JOIN k LEFT JOIN u1 ON u1.c = t.c LEFT JOIN u2 ON u2.b = t.b AND u2.c = t.c LEFT JOIN u3 ON u3.a = t.a AND u3.b = t.b AND u3.c = t.c
  LEFT JOIN u1 AS h1 ON h1.c = CASE WHEN t.b = ' begin' THEN ' end' ELSE t.b END LEFT JOIN u2 AS h2 ON h2.b = t.a AND h2.c = t.b),
s AS (SELECT r, count(*) AS n_tokens, sum((c1 > 0)::INT)::BIGINT AS n_known, any_value(n) AS train_tokens, fsum(log10(base)) AS base_score,
    fsum(log10(CASE WHEN h2 > 0 THEN (c3 + {MU[3]} * p2) / (h2 + {MU[3]}) ELSE p2 END)) AS score FROM p GROUP BY 1)
SELECT doc_id, held_out, n_tokens::BIGINT AS n_tokens, n_known, train_tokens, round(base_score, {DIGITS}) AS base_score, round(score, {DIGITS}) AS score FROM d JOIN s USING (r)
"""
