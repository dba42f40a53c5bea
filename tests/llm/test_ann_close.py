"""Nearest neighbours among vectors that half precision cannot tell apart."""

from dataclasses import replace

import numpy as np
import pytest

from catalogsmith.llm import ann


@pytest.mark.parametrize("spread", [0.014, 0.0045])  # cosines of about 0.9998 and 0.99998
def test_near_equal_vectors(spark, spread):
    rng = np.random.default_rng(7)
    n, d, k = 3000, 64, 5
    centre = rng.normal(size=d)
    noise = rng.normal(size=(n, d))
    x = (centre / np.linalg.norm(centre) + spread / np.sqrt(2 * d) * np.sqrt(2) * noise).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    forest = ann.Forest(trees=1, leaf=1000, part=1024)
    got = {}
    for r in ann.nearest(df, every=50, k=k, forest=forest).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = ann._unit(x)
    hits = 0
    for q in range(0, n, 50):
        s = unit @ unit[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:k].tolist()))
    assert np.median(unit[:200] @ unit[200:400].T) > 0.9997
    assert hits >= 0.9 * k * n / 50


def recall(spark, x, every, kind="float", **forest):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in ann.nearest(df, every=every, forest=ann.Forest(**forest)).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    x = np.asarray(x, np.float64)
    unit, hits, asked = x / np.linalg.norm(x, axis=1, keepdims=True), 0, range(0, len(x), every)
    for q in asked:
        s = unit @ unit[q]
        assert all(abs(s[v] - score) < 1e-12 for v, score in got[q].items())
        s[q] = -np.inf
        hits += len(set(got[q]) & set(np.argsort(-s)[:5].tolist()))
    return hits / (5 * len(asked))


def test_groups_of_near_copies(spark):
    """Forty groups of 100 and one of 2,000, in trees of depth 5."""
    rng = np.random.default_rng(3)
    small = np.concatenate([rng.normal(size=32) + 0.02 * rng.normal(size=(100, 32)) for _ in range(40)])
    large = rng.normal(size=32) + 0.001 * rng.normal(size=(2000, 32))
    assert recall(spark, np.concatenate([small, large]).astype(np.float32), 100, leaf=200) >= 0.9


def test_double_vectors(spark):
    """Vectors that are alike as floats are told apart as doubles."""
    rng = np.random.default_rng(4)
    x = np.ones(16) + 1e-9 * rng.normal(size=(300, 16))
    x = x + 1e-5 * rng.normal(size=(300, 16))
    assert recall(spark, x, 20, "double", leaf=64) >= 0.9
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [0.0, 1e-300])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(huge).orderBy("rank").collect()] == [(1, 1.0), (2, 1e-300)]


def test_lots_of_queries_lose_nothing(spark):
    """Every vector is a query, and leaves are dealt to parts and lots far smaller than what visits them."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = ann.Forest(leaf=150, recall=1.0)
    rows = [sorted(map(tuple, ann.nearest(df, every=1, forest=forest).collect())) for forest in (whole, replace(whole, part=40, lot=30, held=70))]
    assert rows[0] == rows[1] and len(rows[0]) == 600 * 5
