"""Recall of pairs at the threshold as vectors, and with them pivots, become more."""

import numpy as np
import pytest

from cohortmart.llm import pivot_index


def units(rng, n, d=64):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def partners(rng, x, cosine):
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("n", [10_000, 40_000])
def test_links_just_above_the_threshold_are_found(spark, n):
    rng = np.random.default_rng(n)
    x = units(rng, n // 2)
    vectors = np.concatenate([x, partners(rng, x, 0.901)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(8)
    got = pivot_index.near_vectors(df).toPandas().set_index("vec_id").sort_index()
    found = got["component_id"].to_numpy()[n // 2 :] == np.arange(n // 2)
    assert found.mean() >= 0.93 and got["n_links"].sum() == 2 * found.sum()


@pytest.mark.parametrize("n_pivots", [1_131, 4_000, 16_384])
def test_shapes_follow_the_pivots(n_pivots):
    """The estimate that picks a shape holds for other pairs, up to the most pivots that there are."""
    rng = np.random.default_rng(n_pivots)
    pivots, some, others = units(rng, n_pivots), units(rng, 300), units(rng, 600)
    shape = next(s for s in pivot_index.SHAPES if pivot_index.planted_recall(pivots, some, s, 0.9, 600) >= pivot_index.TARGET)
    a, b = (pivot_index._nearest(v, pivots, shape[0]) for v in (others, partners(rng, others, 0.9)))
    met = ((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= shape[2]) & (a[:, : shape[1], None] == b[:, None, : shape[1]]).any(axis=(1, 2))
    assert met.mean() >= 0.93


def test_no_shape_reaches_the_target_then_the_last_one_is_taken(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "planted_recall", lambda *_: 0.0)
    df = spark.createDataFrame([(k, k, [1.0, float(k)]) for k in range(50)], "k1 long, k2 long, vec array<double>")
    assert pivot_index.pick_shape(df, {2: units(np.random.default_rng(1), 4, 2)}) == pivot_index.SHAPES[-1]
    assert pivot_index.pick_shape(df, {}) == pivot_index.SHAPES[0]
