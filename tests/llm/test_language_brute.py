"""Language identification against naive Bayes in plain Python; a text's answer doesn't depend on its neighbours."""

import math
import random
from collections import Counter, defaultdict

from helixframe.llm import langid


def grams(text):
    """(order, bucket) of each counted n-gram of one text."""
    low = "  " + (text or "").lower() + "    "
    signs = [c if c.isalpha() else " " for c in low]
    for i in range(len(low) - 4):
        if signs[i] == " " and signs[i + 1] == " ":
            continue
        h = 0x9E3779B1
        for j in range(3):
            h = ((h ^ ord(signs[i + j])) * 0x85EBCA6B) % (1 << 32)
            h ^= h >> 15
            if j:
                yield j - 1, h >> (32 - langid.BUCKET_BITS)


def test_against_plain_naive_bayes(spark):
    rng = random.Random(12)
    kinds = {"aa": "lo mi ka", "bb": "schu pf ng", "cc": "eau oi qu"}
    make = lambda k: " ".join("".join(rng.choice((kinds[k] + " lo ng").split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 9)))
    rows = [(i, make(k), k) for i in range(150) for k in [rng.choice(sorted(kinds))]] + [(900, None, "aa"), (901, "", "bb"), (902, "12 !", "cc"), (903, "Ünd ñ É", None), (904, "x" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id < 100"))
    count = {k: [Counter(), Counter()] for k in sorted(kinds)}
    for i, t, k in rows:
        if i < 100:
            for order, bucket in grams(t):
                count[k][order][bucket] += 1
    size = 1 << langid.BUCKET_BITS
    logp = lambda k, o, b: math.log(count[k][o][b] + 0.5) - math.log(sum(count[k][o].values()) + 0.5 * size)
    want = {}
    for i, t, _ in rows:
        total = defaultdict(float)
        for order, bucket in grams(t):
            for k in count:
                total[k] += logp(k, order, bucket)
        if not any(c.isalpha() for c in t or ""):
            want[i] = ("und", 0.0)
            continue
        top = max(total.values())
        best = min(k for k in total if total[k] == top)
        want[i] = (best, 1 / sum(math.exp(x - top) for x in total.values()))
    for parts in (1, 7):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df.repartition(parts), model).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and math.isclose(got[i][1], want[i][1], rel_tol=1e-9, abs_tol=1e-12) for i in want)
