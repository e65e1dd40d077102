"""Recall of op10's tables on vectors with a common direction, against brute force."""

import numpy as np
import pytest

from helixframe.llm import embedding_dedup


def skewed(rng, n, mean, dim=64):
    """Unit vectors whose mean cosine with each other is ``mean`` about."""
    common = rng.standard_normal(dim)
    x = rng.standard_normal((n, dim)) * np.sqrt((1 - mean) / dim) + np.sqrt(mean) * common / np.linalg.norm(common)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("mean", "n"), [(0.0, 20_000), (0.81, 20_000), (0.9, 20_000), (0.81, 3_000_000)])
def test_tables_meet_at_the_threshold(mean, n):
    rng = np.random.default_rng(5)
    x = skewed(rng, 6000, mean)
    width, codes = embedding_dedup.plan(x, n, 0.98, embedding_dedup.RECALL)
    a = skewed(np.random.default_rng(5), 6000, mean)[rng.integers(0, 6000, 20_000)]
    d = rng.standard_normal(a.shape)
    d -= (d * a).sum(1, keepdims=True) * a
    cos = rng.uniform(0.98, 0.985, (len(a), 1))
    b = cos * a + np.sqrt(1 - cos**2) * d / np.linalg.norm(d, axis=1, keepdims=True)
    meet = (embedding_dedup.keys_of(a, codes, width) == embedding_dedup.keys_of(b, codes, width)).any(1)
    print(mean, n, "width", width, "tables", len(codes) * (codes[0][1].shape[1] // width), "recall", meet.mean())
    assert meet.mean() >= 0.9995


def test_links_of_skewed_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    x = skewed(rng, 900, 0.9)
    near = x + 0.02 * rng.standard_normal(x.shape)
    x = np.concatenate([x, near])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert links.sum() > 500
    assert sum(got.values()) >= 0.999 * links.sum() and all(got[i] <= n for i, n in enumerate(links))
