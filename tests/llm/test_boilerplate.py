"""Texts that share boilerplate, but are no near-duplicates, don't send their shingle sets around (op 6)."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from helixframe.llm import ngram_join


def sent(texts):
    """How often each text's set would travel to a bucket."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "th", "text"])
    rows = pa.Table.from_batches(list(ngram_join._signatures(iter([batch]))))
    buckets = defaultdict(list)
    for i, keys in enumerate(rows.column("keys").to_pylist()):
        for band, key in enumerate(keys):
            buckets[band, key].append(i)
    out, find = Counter(), ngram_join._candidates(0.8)
    for (band, _), members in buckets.items():
        if len(members) > 1:
            n = len(members)
            g = rows.take(pa.array(members)).select(["cid", "sig", "size"])
            for name, value in (("gid", np.zeros(n, np.int64)), ("tile", np.zeros(n, np.int64)), ("cross", np.zeros(n, bool)), ("band", np.full(n, band, np.int32))):
                g = g.append_column(name, pa.array(value))
            got = find(g.combine_chunks())
            for i in got.column("cid").to_pylist() if got else ():
                out[i] += 1
    return out, buckets


def test_boilerplate():
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**8)}" for _ in range(n))
    shared = fresh(120)
    out, buckets = sent([f"{shared} {fresh(60)}" for _ in range(400)])
    assert max(map(len, buckets.values())) > 40  # they do meet
    assert sum(out.values()) <= 3 * 400 and max(out.values(), default=0) <= 12


def test_copies_are_found():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**8)}" for _ in range(200)]
    near = []
    for _ in range(100):  # one word in 200 changed: five shingles of 196
        w = list(words)
        w[rng.randrange(200)] = "new"
        near.append(" ".join(w))
    out, _ = sent(near)
    assert len(out) >= len(set(near)) - 1
    assert max(out.values()) <= 24
