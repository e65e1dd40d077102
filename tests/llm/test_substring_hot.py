"""A bucket of many alike paragraphs is verified in the memory of a part of them, with the same result."""

import tracemalloc

import numpy as np
import pyarrow as pa

from helixframe.llm import substring_dedup as sd


def bucket(n: int, gids: int = 1) -> pa.Table:
    """Runs of one word changed at different places, and some that share nothing."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 32, sd.WIDE + 9, dtype=np.uint32)
    sets = []
    for i in range(n):
        x = base.copy() if i % 7 else r.integers(0, 1 << 32, len(base), dtype=np.uint32)
        at = int(r.integers(0, len(x) - sd.LOST))
        x[at : at + sd.LOST] = r.integers(0, 1 << 32, sd.LOST, dtype=np.uint32)
        sets.append(x.tobytes())
    i = np.arange(n)
    return pa.table({"pos": (i * 0).astype(np.int32), "name": i + 1000, "gid": np.sort(i % gids), "tiled": i < 0, "doc": i, "first": i, "lo": i, "hi": i, "sets": pa.array(sets, pa.binary())})


def rows(t: pa.Table) -> list[tuple]:
    return sorted(map(repr, t.to_pylist()))


def test_parts_give_what_the_whole_gives(monkeypatch):
    t = bucket(700, 3)
    monkeypatch.setattr(sd, "PART", 1 << 20)
    want = rows(sd._verify(t))
    monkeypatch.setattr(sd, "PART", 64)
    assert rows(sd._verify(t)) == want and len(want) > 500


def test_memory_of_a_hot_bucket():
    t = bucket(4096)
    tracemalloc.start()
    sd._verify(t)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
