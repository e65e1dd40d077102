"""Near and exact repeats of op7 against brute force over all pairs of 50-word paragraphs."""

import random

from helixframe.llm import substring_dedup


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def shingles(w, a, b):
    return {tuple(w[k : k + 5]): k for k in range(a, b - 4)}


def brute(docs):
    """Words of each document that a paragraph of another one covers, and those of an earlier one."""
    every, gone = {i: set() for i in docs}, {i: set() for i in docs}
    for i, x in docs.items():
        for j, y in docs.items():
            if i == j or not set(x) & set(y):
                continue
            there = [set(shingles(y, b, b + 50)) for b in range(len(y) - 49)]
            for a in range(len(x) - 49):
                own = shingles(x, a, a + 50)
                for other in there:
                    both = own.keys() & other
                    if len(both) >= 0.8 * (len(own) + len(other) - len(both)) - 1e-9:
                        at = [own[s] for s in both]
                        every[i] |= set(range(min(at), max(at) + 5))
                        if j < i:
                            gone[i] |= set(range(min(at), max(at) + 5))
    return every, gone


def answers(spark, docs):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.repeats(df).collect()}
    cover = lambda i, c: {k for s in (got[i][c] if i in got else []) for k in range(s["start"], s["end"])}
    return got, {i: cover(i, "spans") for i in docs}, {i: cover(i, "removed") for i in docs}


def changed(rng, w, how, k):
    return w[:k] + {"swap": ["new"], "in": ["new", w[k]], "out": []}[how] + w[k + 1 :]


def test_near_copies_against_brute_force(spark):
    rng, docs, n = random.Random(3), {}, 0
    for size in (50, 55, 60):
        for how in ("swap", "in", "out"):
            for k in range(0, size, 7):
                p = fresh(rng, size)
                around = (10, 20) if k % 2 else (0, 0)  # within texts, and as whole texts
                for w in (p, changed(rng, p, how, k)):
                    docs[n] = fresh(rng, around[0]) + w + fresh(rng, around[1])
                    n += 1
    every, gone = brute(docs)
    _, got, removed = answers(spark, docs)
    assert sum(bool(x) for x in every.values()) > 120
    assert got == every
    assert removed == gone


def test_whole_passages_are_covered(spark):
    rng, docs, want, n = random.Random(4), {}, {}, 0
    for size in (50, 51, 60, 75, 100, 300):
        p = fresh(rng, size)
        for _ in range(3):
            a = rng.randrange(60)
            docs[n] = fresh(rng, a) + p + fresh(rng, rng.randrange(60))
            want[n] = set(range(a, a + size))
            n += 1
    got, spans, removed = answers(spark, docs)
    assert spans == want
    assert removed == {i: want[i] if i % 3 else set() for i in docs}
    assert all(r["n_repeated"] == len(want[i]) for i, r in got.items())


def test_tiles_and_loops(spark, monkeypatch):
    rng = random.Random(5)
    p, loop = fresh(rng, 60), fresh(rng, 7)
    docs = {i: fresh(rng, 9) + p + fresh(rng, 30) for i in range(12)} | {20: loop * 12, 21: fresh(rng, 12) + loop * 10, 30: ["der"] * 120, 31: ["der"] * 77, 40: fresh(rng, 49)}
    whole = answers(spark, docs)[1:]
    assert whole[0][20] == set(range(84)) and whole[0][21] == set(range(12, 82)) and whole[0][31] == set(range(77)) and whole[0][3] == set(range(9, 69))
    monkeypatch.setattr(substring_dedup, "TILE", 3)
    assert answers(spark, docs)[1:] == whole
