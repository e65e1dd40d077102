"""Substring dedup: MinHash bands over all 50-word paragraphs, exact Jaccard in each bucket, components.

Repeated passages begin anywhere in a text, so paragraphs are all windows of ``PASSAGE`` words,
as sets of five-word shingles.  Texts that are equal are handled once, as one content.

1. *Prefilter, without loss.*  Two paragraphs of a Jaccard similarity of 0.8 share 41 of 46
   shingles at least, so they have ``RUN`` words in a row in common.  The minima of
   ``GRAM``-word hashes over each ``RUN`` words are a text's anchors; only paragraphs that hold
   an anchor of another content go on.
2. *Bands.*  Each paragraph has ``BANDS`` keys of ``ROWS`` minima, by sliding minima over the text.
   Neighbouring paragraphs mostly share a key and are one row, a run.  A pair of similarity s
   meets with a probability of 1 - (1 - s**ROWS)**BANDS:
   0.994 at 0.8, 0.998 at 0.85, 0.9998 at 0.9, 0.38 at 0.3, 0.05 at 0.1.
3. *Verification in each bucket.*  Runs of equal words are one class, and of each distinct
   set of shingles one paragraph is looked at.  At 0.8 a paragraph lacks five shingles at most: those around one
   word that was changed, put in or left out, or at its ends.  So two paragraphs are alike if
   they agree once such a block is dropped from each; the sums of hashes that remain are
   sorted, and equal sums are shared sets of 41 shingles or more.  That is exact and linear in the
   bucket, however many near copies it holds.  A bucket beyond ``TILE``
   classes is dealt out in pairs of tiles.
4. *Removal.*  A verified paragraph covers the words from its first shared shingle to its last, so the union
   covers a repeated passage from end to end, and no word beside it.  Components of the
   links are the clusters; a covered word is removed if an earlier document (by id) has the
   paragraph.

Not sought: paragraphs that are alike only with two blocks exchanged.  In texts that loop, a paragraph has fewer distinct
shingles; there a block of up to an eighth of what stays may be dropped from each side.

Edge cases: texts of less than ``PASSAGE`` words, null and empty ones have no paragraph;
rows with equal id and text are one document, with equal id and other text several; a
passage repeated only inside one document stays; an empty table gives no rows; other
columns are ignored.  A very long text is handled in one piece by its task, with some 100 bytes for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import kernel
from .common import dropped, saved, table
from .components import components, grouped, tiles

SHINGLE = 5
PASSAGE = 50
RUN, GRAM = 25, 10
BANDS, ROWS = 5, 2
TILE = 2048
#: Shingles of a paragraph, and how many of them a paragraph of a similarity of 0.8 may lack.
WIDE = PASSAGE - SHINGLE + 1
LOST = 5
#: Distinct paragraphs whose keys are sorted at once (a bucket's are never parted).
CHUNK = 1 << 10
#: Paragraphs of one bucket whose keys are held at once.
PART = 1 << 12

U = np.uint64
_ODD = np.random.default_rng(20240301).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def _sliding(x: np.ndarray, w: int, op: np.ufunc, pad: int) -> np.ndarray:
    """``op`` over each ``w`` neighbours of ``x``, by block-wise running values."""
    n = len(x)
    full = -(-n // w) * w
    y = np.full(full, U(pad), dtype=U)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = op.accumulate(y, axis=1).reshape(-1)
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position and key of the anchors of texts with word hashes ``h``."""
    w = RUN - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(h) < PASSAGE:
        return none, none, np.zeros(0, U)
    g = kernel.grams(h, GRAM)
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    low = _sliding(g, w, np.minimum, (1 << 64) - 1)
    # windows of RUN words that lie within one text of PASSAGE words or more
    j = np.arange(len(low))
    inside = np.zeros(len(low), bool)
    ok = j + RUN <= len(h)
    inside[ok] = (row[j[ok]] == row[j[ok] + RUN - 1]) & (size[row[j[ok]]] >= PASSAGE)
    low = np.where(inside, low, U(0))
    top = _sliding(np.concatenate([np.zeros(w - 1, U), low]), w, np.maximum, 0)
    pos = np.flatnonzero((top == g[: len(top)]) & (top > 0))
    key, r = g[pos], row[pos]
    at = pos - offs[r]
    order = np.lexsort((at, key, r))  # in loops of words one anchor for each run is enough
    key, r, at = key[order], r[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (r[1:] != r[:-1]) | (at[1:] // RUN != at[:-1] // RUN)
    return r[new], at[new], key[new]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, doc_id, text to anchors (key, content, pos), and for each text with paragraphs doc_id and its number of words."""
    for batch in batches:
        for a, b in kernel.slices(batch.column(2)):
            part = batch.slice(a, b - a)
            h, offs = kernel.words(part.column(2), kernel.ALNUM)
            r, at, key = anchors(h, offs)
            size = np.diff(offs)
            long = np.flatnonzero(size >= PASSAGE)
            m, n = len(r), len(long)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(key.view(np.int64)), pa.nulls(n, pa.int64())]), part.column(0).take(pa.array(np.concatenate([r, long]))), pa.concat_arrays([pa.array(at.astype(np.int32)), pa.nulls(n, pa.int32())]),
                pa.concat_arrays([pa.nulls(m, pa.int64()), part.column(1).take(pa.array(long))]), pa.concat_arrays([pa.nulls(m, pa.int32()), pa.array(size[long].astype(np.int32))]),
            ], names=["key", "content", "pos", "doc_id", "whole"])


def _hits(part: pa.RecordBatch, column: int) -> tuple[np.ndarray, pa.Array]:
    lists = part.column(column)
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def candidates(offs: np.ndarray, r: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which paragraphs (by first word, over the slice) hold an anchor at ``pos`` of text ``r``."""
    size = np.diff(offs)
    edge = np.zeros(int(offs[-1]) + 1, np.int32)
    lo, hi = np.maximum(pos + GRAM - PASSAGE, 0), np.minimum(pos, size[r] - PASSAGE)
    np.add.at(edge, offs[r] + lo, 1)
    np.add.at(edge, offs[r] + hi + 1, -1)
    return np.cumsum(edge)[:-1] > 0


def bands(h: np.ndarray) -> Iterator[np.ndarray]:
    """For each band the key of the paragraph that begins at each word."""
    g = kernel.grams(h, SHINGLE)
    for b in range(BANDS):
        key = np.full(len(h) - WIDE + 1, U(b + 1))
        for k in range(b * ROWS, (b + 1) * ROWS):
            key = kernel.mix(key * U(kernel.MULT) + _sliding(g * _ODD[k], WIDE, np.minimum, (1 << 64) - 1))
        yield key


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """content, doc, text, anchors (positions) to runs of paragraphs with one band key."""
    for batch in batches:
        for a, b in kernel.slices(batch.column(2)):
            part = batch.slice(a, b - a)
            h, offs = kernel.words(part.column(2), kernel.ALNUM)
            if len(h) < PASSAGE:
                continue
            r, flat = _hits(part, 3)
            on = candidates(offs, r, flat.to_numpy().astype(np.int64))[: len(h) - WIDE + 1]
            g = kernel.mix(kernel.grams(h, SHINGLE))
            power = kernel._powers(kernel.MULT, len(h) + 1)
            total = np.zeros(len(h) + 1, U)
            np.cumsum(g * power[: len(h)], out=total[1:])
            back = kernel._powers(kernel._INVERSE, len(h) + 1)
            row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(on)]
            for band, key in enumerate(bands(h)):
                cut = np.ones(len(on) + 1, bool)
                cut[1:-1] = (key[1:] != key[:-1]) | (on[1:] != on[:-1]) | (row[1:] != row[:-1])
                at = np.flatnonzero(cut)
                s, e = at[:-1], at[1:]
                s, e = s[on[s]], e[on[s]]
                words = (total[e + WIDE - 1] - total[s]) * back[s]
                name = kernel.mix(kernel.mix(words) ^ key[s])
                of = pa.array(row[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), band, np.int32)), pa.array(key[s].view(np.int64)), pa.array(name.view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array((s - offs[row[s]]).astype(np.int32)), pa.array((e - s).astype(np.int32))],
                    names=["band", "key", "name", "content", "doc", "pos", "many"],
                )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and wants (structs pos, many, name, gid, tiled, doc, first, lo, hi) to the wanted runs' shingles."""
    for batch in batches:
        for a, b in kernel.slices(batch.column(0)):
            part = batch.slice(a, b - a)
            h, offs = kernel.words(part.column(0), kernel.ALNUM)
            r, flat = _hits(part, 1)
            short = (kernel.grams(h, SHINGLE) >> U(32)).astype(np.uint32)
            for i in range(0, len(r), CHUNK):
                own = flat.slice(i, CHUNK)
                start = offs[r[i : i + CHUNK]] + own.field(0).to_numpy()
                size = own.field(1).to_numpy().astype(np.int64) + WIDE - 1
                _, at = kernel.runs(start, size)
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut * np.int32(4)), pa.py_buffer(np.ascontiguousarray(short[at]))])
                yield pa.RecordBatch.from_arrays([own.field(0), *[own.field(k) for k in range(2, 9)], data], names=["pos", "name", "gid", "tiled", "doc", "first", "lo", "hi", "sets"])


class Windows:
    """The distinct paragraphs of the buckets of some runs, with the contents that have them."""

    def __init__(self, gid: np.ndarray, flat: np.ndarray, cut: np.ndarray, rank: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """``flat[cut[u]:cut[u + 1]]``: shingles of run ``u``; ``rank``, ``lo``, ``hi``: its first document, least and greatest content."""
        size = np.diff(cut)
        v = kernel.mix(flat.astype(U) * U(kernel.MULT) + U(1))
        self.unit, start = kernel.runs(cut[:-1], size - WIDE + 1)
        self.at = start - cut[self.unit]
        # places of the last equal shingle of the run: a paragraph loops if it holds both
        run = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, run))
        same = (flat[order[1:]] == flat[order[:-1]]) & (run[order[1:]] == run[order[:-1]])
        before = np.full(len(flat), -1)
        before[order[1:][same]] = order[:-1][same]
        # a shingle counts in the paragraphs that begin after its last equal one
        first = np.maximum(np.maximum(before + 1, np.arange(len(flat)) - WIDE + 1), cut[run])
        edge, count = np.zeros(len(flat) + 1, U), np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, first, v)
        np.add.at(count, first, 1)
        edge[1:] -= v
        count[1:] -= 1
        total, distinct = np.cumsum(edge, dtype=U)[start], np.cumsum(count)[start]
        name = kernel.mix(total ^ kernel.mix(gid[self.unit].astype(U)))
        _, pick, self.of = np.unique(name, return_index=True, return_inverse=True)
        self.n, self.v, self.before, self.start = len(pick), v, before, start[pick]
        self.total, self.distinct, self.gid = total[pick], distinct[pick], gid[self.unit[pick]].astype(U)
        self.ends = np.zeros(self.n, bool)  # last of a run
        self.ends[self.of[self.at + WIDE == size[self.unit]]] = True
        self.rank = np.full(self.n, len(rank))
        self.lo, self.hi = np.full(self.n, np.iinfo(np.int64).max), np.full(self.n, np.iinfo(np.int64).min)
        np.minimum.at(self.rank, self.of, rank[self.unit])
        np.minimum.at(self.lo, self.of, lo[self.unit])
        np.maximum.at(self.hi, self.of, hi[self.unit])

    def plain(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of paragraphs ``own`` without a loop: number, what remains without a block, shingles missing at the start and end.

        What the next paragraph of the run has as well is left to it.
        """
        x = self.v[self.start[own][:, None] + np.arange(WIDE)]
        run = np.zeros((len(own), WIDE + LOST), U)
        np.cumsum(np.concatenate([x, x[:, : LOST - 1]], axis=1), axis=1, out=run[:, 1:])
        total = self.total[own][:, None]
        end = self.ends[own]
        five = total - (run[:, LOST:] - run[:, :WIDE])  # without the five from c on, round the end
        c = np.arange(WIDE)
        front = np.maximum(c + LOST - WIDE, 0)
        left, right = np.where(c == 0, LOST, front), np.where(c + LOST >= WIDE, LOST - front, 0)
        every = (c > 0) & (c + LOST <= WIDE)
        yield from self._spread(own, five[:, every], left[every], right[every])
        yield from self._spread(own[end], five[end][:, ~every], left[~every], right[~every])
        four = total - (run[:, LOST:WIDE] - run[:, 1 : WIDE - LOST + 1])  # without a block of four inside and an end
        none = np.zeros(four.shape[1], np.int64)
        first, last = none + 1, none + 1
        first[0] = last[-1] = LOST  # the block lies beside the end
        yield from self._spread(own, four - x[:, -1:], none, last)
        yield from self._spread(own[end], four[end] - x[end, :1], first, none)

    @staticmethod
    def _spread(own: np.ndarray, rest: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        n, m = rest.shape
        yield np.repeat(own, m), rest.reshape(-1), np.tile(left, n), np.tile(right, n)

    def looped(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """As :meth:`plain`, of paragraphs that loop: blocks of up to an eighth of what stays."""
        for size in np.unique(self.distinct[own]).tolist():
            part = own[self.distinct[own] == size]
            at = self.start[part][:, None] + np.arange(WIDE)
            value = self.v[at]
            place = np.nonzero(self.before[at] < self.start[part][:, None])[1].reshape(len(part), size)  # first places of the distinct shingles
            x = np.take_along_axis(value, place, 1)
            last = np.stack([WIDE - 1 - (value[:, ::-1] == x[:, k : k + 1]).argmax(1) for k in range(size)], axis=1)
            low = np.full((len(part), 1), -1)
            upto = np.concatenate([low, np.maximum.accumulate(last, axis=1)], axis=1)
            since = np.concatenate([np.maximum.accumulate(last[:, ::-1], axis=1)[:, ::-1], low], axis=1)
            run = np.zeros((len(part), 2 * size + 1), U)
            np.cumsum(np.concatenate([x, x], axis=1), axis=1, out=run[:, 1:])
            total = self.total[part][:, None]
            for drop in range(size // 9 + 1):
                c = np.arange(size if drop else 1)
                rest = total - (run[:, drop : drop + len(c)] - run[:, : len(c)])
                wrap = c + drop > size
                left = place[:, np.where(c == 0, drop, np.where(wrap, c + drop - size, 0))]
                end = np.maximum(upto[:, c], since[:, np.minimum(c + drop, size)])
                for k in np.flatnonzero(wrap).tolist():
                    end[:, k] = last[:, k + drop - size : k].max(1)
                yield np.repeat(part, len(c)), rest.reshape(-1), left.reshape(-1), (WIDE - 1 - end).reshape(-1)

    def alike(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Paragraphs with a partner of another content in their bucket: number, shingles missing at the start
        and end, first document, least and greatest content, and a paragraph that stands for all its partners."""
        loop = self.distinct < WIDE
        order = np.argsort(self.gid, kind="stable")
        gid = self.gid[order]
        ends = np.flatnonzero(np.append(gid[1:] != gid[:-1], True)) + 1
        # a number for each content; paragraphs of several have one of their own
        some = np.where(self.lo == self.hi, self.lo, np.arange(self.n)).astype(U) ^ np.where(self.lo == self.hi, U(0), U(kernel.MULT))
        some = (kernel.mix(some) >> U(40)).astype(np.float64) + 1  # none is 0, so that sums show it
        a = 0
        while a < self.n:  # whole buckets
            b = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + CHUNK))])
            own = order[a:b]
            a = b
            # equal keys share a remainder, so a large bucket is done by remainders, in the memory of ``PART`` paragraphs
            rounds = 1 << (len(own) // PART).bit_length()
            for r in range(rounds):
                parts = [self._entries(own[i : i + PART], loop, rounds, r) for i in range(0, len(own), PART)]
                which, key, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
                # slots where all entries are of one content hold no partners
                bits = max(12, int(len(key)).bit_length() + 1)
                slot, of = (key >> U(64 - bits)).astype(np.int64), some[which]
                mean = np.bincount(slot, of, 1 << bits)
                twice = np.flatnonzero(mean[slot] != of)
                twice = twice[(np.bincount(slot, minlength=1 << bits)[slot[twice]] * of[twice]) != mean[slot[twice]]]
                twice = twice[np.argsort(key[twice])]
                k = key[twice]
                if not len(k):
                    continue
                new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                more = np.diff(np.append(new, len(k))) > 1
                pick = np.repeat(more, np.diff(np.append(new, len(k))))
                twice, k = twice[pick], k[pick]
                if not len(k):
                    continue
                new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                segment = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(k))))
                w = which[twice]
                lo, hi = np.minimum.reduceat(self.lo[w], new), np.maximum.reduceat(self.hi[w], new)
                rank, head = np.minimum.reduceat(self.rank[w], new), np.minimum.reduceat(w, new)
                ok = (lo != hi)[segment]
                s, t = segment[ok], twice[ok]
                yield w[ok], left[t], right[t], rank[s], lo[s], hi[s], head[s]

    def _entries(self, own: np.ndarray, loop: np.ndarray, rounds: int, r: int) -> tuple[np.ndarray, ...]:
        """Of paragraphs ``own``: number, key of what remains, shingles missing at the start and end, for keys of remainder ``r``."""
        plain, looped = own[~loop[own]], own[loop[own]]
        parts = [*(self.plain(plain) if len(plain) else ()), *(self.looped(looped) if len(looped) else ())]
        which, rest, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = kernel.mix(rest ^ kernel.mix(self.gid[which]))
        if rounds == 1:
            return which, key, left, right
        keep = (key & U(rounds - 1)) == U(r)
        return which[keep], key[keep], left[keep], right[keep]


def _least(cols: np.ndarray) -> np.ndarray:
    """Of rows (paragraph, left, right, first document) of equal first three the least."""
    if not cols.shape[1]:
        return cols
    cell = (cols[0] * WIDE + cols[1]) * WIDE + cols[2]
    order = np.argsort(cell, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
    return np.stack([*cols[:3, order[new]], np.minimum.reduceat(cols[3, order], new)])


def _verify(t: pa.Table) -> pa.Table | None:
    """Runs of whole buckets (by gid, in order) to covered words of each run's first content: content, start, end, removed, cluster.

    Rows with ``to`` link the class ``cluster``, which several contents or buckets have, to another.
    """
    gid, name = t.column("gid").to_numpy(), t.column("name").to_numpy()
    doc, first, lo, hi, place = (t.column(x).to_numpy() for x in ("doc", "first", "lo", "hi", "pos"))
    data = t.column("sets").to_pylist()
    cut = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])])
    by = np.lexsort((first, doc))
    d, f = doc[by], first[by]
    rank = np.empty(len(gid), np.int64)  # of the first document; equal ones share a number
    rank[by] = np.cumsum(np.concatenate([[0], (d[1:] != d[:-1]) | (f[1:] != f[:-1])]))
    w = Windows(gid, np.frombuffer(b"".join(data), np.uint32), cut, rank, lo, hi)
    own = np.full(w.n, -1)
    own[w.of[::-1]] = w.unit[::-1]  # a run that has the paragraph
    # equal paragraphs of several contents, then alike ones: (paragraph, left, right, first document)
    twin = w.lo != w.hi
    many = np.flatnonzero(twin)
    records = [np.stack([many, np.zeros_like(many), np.zeros_like(many), w.rank[many]])]
    links = [(w.unit[twin[w.of]], own[w.of[twin[w.of]]])]
    for which, left, right, r, _, _, head in w.alike():
        keep = ~(twin[which] & (w.rank[which] <= r))  # equal ones say as much
        cols = np.stack([which, left, right, r])[:, keep]
        if cols.shape[1]:
            records.append(_least(cols))
        if len(records) > 16:
            records = [_least(np.concatenate(records, axis=1))]
        pair = np.unique(own[which] * len(gid) + own[head])
        links.append((pair // len(gid), pair % len(gid)))
    found = _least(np.concatenate(records, axis=1))
    if not found.shape[1]:
        return None
    # to the runs that have the paragraph, neighbours with one answer together
    found = found[:, np.argsort(found[0], kind="stable")]
    begin, end = np.searchsorted(found[0], np.arange(w.n)), np.searchsorted(found[0], np.arange(w.n), side="right")
    here, at = kernel.runs(begin[w.of], (end - begin)[w.of])
    unit, pos = w.unit[here], w.at[here]
    gone = found[3, at] < rank[unit]
    start, stop = pos + found[1, at], pos + PASSAGE - found[2, at]
    mark = unit * 2 + gone
    order = np.lexsort((start, mark))
    mark, start, stop = mark[order], start[order], stop[order]
    reach = np.maximum.accumulate(stop + mark * (1 << 32)) - mark * (1 << 32)  # marks rise, so a run's reach is its own
    new = np.ones(len(mark), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (start[1:] > reach[:-1])
    s = np.flatnonzero(new)
    stop = reach[np.append(s[1:], len(mark)) - 1]
    unit = mark[s] // 2
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    root = _roots(len(gid), a, b)
    tied = np.flatnonzero((root != np.arange(len(gid))) & ((lo != hi) | t.column("tiled").to_numpy(zero_copy_only=False)))
    none, zero = pa.nulls(len(tied), pa.int64()), np.zeros(len(tied), np.int32)
    return pa.table({
        "content": pa.concat_arrays([pa.array(first[unit]), none]), "start": np.concatenate([(start[s] + place[unit]).astype(np.int32), zero]), "end": np.concatenate([(stop + place[unit]).astype(np.int32), zero]),
        "removed": pa.array(np.concatenate([mark[s] % 2 == 1, zero > 0])), "cluster": np.concatenate([name[root[unit]], name[tied]]), "to": pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(name[root[tied]])]),
    })


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that the links ``a``, ``b`` reach from each of ``n``."""
    root = np.arange(n)
    pair = np.unique(a * n + b)
    a, b = pair // max(n, 1), pair % max(n, 1)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def union(x: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s, e in sorted(x):
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(e, out[-1][1]))
            else:
                out.append((s, e))
        return out

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            found = r["found"] or []
            every = union([(p["start"], p["end"]) for p in found] + ([(0, r["whole"])] if r["whole"] else []))
            gone = union([(p["start"], p["end"]) for p in found if p["removed"]] + ([(0, r["whole"])] if r["whole"] and r["later"] else []))
            rows.append({
                "doc_id": r["doc_id"], "n_repeated": sum(e - s for s, e in every), "n_removed": sum(e - s for s, e in gone),
                "spans": [{"start": s, "end": e} for s, e in every], "removed": [{"start": s, "end": e} for s, e in gone],
                "clusters": sorted({p["cluster"] for p in found} | ({r["content"]} if r["whole"] else set())),
            })
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("n_repeated", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("removed", span), ("clusters", pa.list_(pa.int64()))]))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with repeated passages: doc_id, n_repeated and n_removed words, spans, removed, clusters."""
    ship(docs.sparkSession)
    body = F.col(f"`{text}`")
    rows = docs.where(body.isNotNull()).select(F.xxhash64(body).alias("content"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))  # a null is before all ids
    found = saved(rows.mapInArrow(_anchor_rows, "key long, content long, pos int, doc_id long, whole int"), compression="zstd")
    members = saved(found.where("key IS NULL").select("content", "doc_id", "whole").distinct())
    contents = members.groupBy("content").agg(F.min(order).alias("doc"), F.count("*").alias("docs"), F.first("whole").alias("whole"))
    held = found.where("key IS NOT NULL").select("key", "content", "pos")
    # stored, so that the join's sides are both dealt out anew and adaptive execution can split a hot anchor
    shared = saved(held.groupBy("key").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").select("key"))
    hits = held.join(shared, "key").groupBy("content").agg(F.collect_set("pos").alias("hits"))
    near = saved(rows.select("content", "text").dropDuplicates(["content"]).join(hits, "content").join(contents, "content").select("content", "doc", "text", "hits"), compression="zstd")
    dropped(found)
    runs = saved(near.mapInArrow(_run_rows, "band int, key long, name long, content long, doc long, pos int, many int"), compression="zstd")
    classes = runs.groupBy("key", "name").agg(F.min(F.struct("doc", "content", "pos", "many", "band")).alias("f"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    # of a key, classes of several contents or several classes; the rest has no partner
    classes = saved(classes.select("key", "name", "f.*", "lo", "hi").withColumnRenamed("content", "first"))
    buckets = classes.groupBy("key").agg(F.count("*").alias("members"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("members > 1 AND lo <> hi").select("key", "members")
    dealt = classes.join(buckets, "key").withColumn("to", F.explode(tiles(F.col("key"), F.col("name"), F.col("members"), TILE)))
    want = F.struct("pos", "many", "name", "to.gid", (F.col("members") > TILE).alias("tiled"), "doc", "first", "lo", "hi")
    wants = dealt.groupBy(F.col("first").alias("content")).agg(F.collect_list(want).alias("wants"))
    sets = near.join(wants, "content").select("text", "wants").mapInArrow(_set_rows, "pos int, name long, gid long, tiled boolean, doc long, first long, lo long, hi long, sets binary")
    verified = saved(grouped(sets, "gid", _verify, "content long, start int, end int, removed boolean, cluster long, to long", whole=True))
    dropped(near)
    clusters = components(verified.where("to IS NOT NULL").select(F.col("cluster").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "cluster")
    # equal runs: every band has them, so the first one's will do; all but the first document's are removed
    equal = classes.where("lo <> hi AND band = 0").select("name", F.struct("doc", "first").alias("f"))
    own = runs.where("band = 0").select("name", "content", "doc", "pos", "many").join(equal, "name")
    same = own.select("content", F.col("pos").alias("start"), (F.col("pos") + F.col("many") + PASSAGE - 1).alias("end"), (F.struct("doc", "content") > F.col("f")).alias("removed"), F.col("name").alias("cluster"))
    marked = same.unionByName(verified.where("to IS NULL").drop("to")).join(clusters, "cluster", "left")
    span = F.struct("start", "end", F.coalesce("component", "cluster").alias("cluster"), "removed")
    lists = marked.groupBy("content").agg(F.collect_set(span).alias("found"))
    # texts that several documents have are repeated from end to end
    copies = contents.where("docs > 1").select("content", F.col("doc").alias("least"), "whole")
    every = lists.join(copies, "content", "full").select("content", "found", "least", "whole")
    out = members.select("content", "doc_id").join(saved(every), "content").select("doc_id", "content", "found", "whole", (order > F.col("least")).alias("later"))
    span = "array<struct<start:int,end:int>>"
    return out.mapInArrow(_spans, f"doc_id long, n_repeated long, n_removed long, spans {span}, removed {span}, clusters array<long>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that repeat across documents."""
    return repeats(table(spark, sf_dir, "documents"))
