from __future__ import annotations

import numpy as np
import pytest

from orderscope.llm import embedding_dedup
from orderscope.llm.embedding_dedup import _labels, embedding_links

INF, NAN = float("inf"), float("nan")


def brute(ids, vectors, threshold=0.9):
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = v @ v.T >= threshold
    np.fill_diagonal(close, False)
    label = _labels(len(v), *np.nonzero(close))
    return close, np.asarray(ids)[label]


@pytest.mark.parametrize("block", [256, 16])
def test_recall_and_precision(spark, block, monkeypatch):
    """Families with cosines spread around the threshold, and one large family."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=(300, 32))]
    for k in range(40):
        base = rng.normal(size=32)
        parts.append(base + rng.normal(size=(5, 32)) * rng.uniform(0.02, 0.45))
    parts.append(rng.normal(size=32) + rng.normal(size=(150, 32)) * 0.05)
    vectors = np.concatenate(parts).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows = {r["vec_id"]: r for r in embedding_links(df).collect()}
    close, label = brute(range(len(vectors)), vectors.astype(np.float64))
    found = sum(r["n_links"] for r in rows.values())
    assert found >= 0.95 * close.sum()
    for i, r in rows.items():
        assert r["n_links"] <= close[i].sum()
        assert r["kept"] == (r["component_id"] == i)
        assert label[r["component_id"]] == label[i]


def test_awkward_vectors(spark):
    data = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0]), (None, [1.0, 0.001]), (10, [1e-30, 1e-30]), (11, [1e30, 1e30]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").selectExpr("*", "'x' as id", "'y' as v", "'z' as w")
    rows = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(df).collect()), key=str)
    assert rows == sorted(
        [(i, 0, i, True) for i in range(1, 7)]
        + [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (9, 4, 7, False), (None, 4, 7, False)]
        + [(10, 1, 10, True), (11, 1, 10, False)],
        key=str,
    )
    assert embedding_links(df.limit(0)).count() == 0
    assert embedding_links(df.where("vec_id < 7")).count() == 6


def test_recall_with_as_many_pivots_as_a_large_table_has(spark, monkeypatch):
    """Pairs just above the threshold, described by 25,000 pivots (about 10 M rows)."""
    rng = np.random.default_rng(5)

    def unit(m):
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    pivots = unit(rng.normal(size=(25_000, 64))).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "_pivots", lambda *_: pivots)
    a, b = unit(rng.normal(size=(600, 64))), rng.normal(size=(600, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    vectors = np.stack([a, 0.901 * a + np.sqrt(1 - 0.901**2) * b], axis=1).reshape(-1, 64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = embedding_links(df).where("n_links > 0").count()
    assert found >= 0.94 * len(vectors)
