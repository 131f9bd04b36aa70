"""Neighbours and outlier factors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from logloom.operators import neighbours
from logloom.operators.neighbours import flag_outliers, leaf_visits, local_outlier_factor, nearest_neighbours, pivot_tree


def brute_lof(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, order, axis=1)
    reach = np.maximum(dist, dist[:, -1][order])
    lrd = 1.0 / (reach.mean(axis=1) + 1e-10)
    return lrd[order].mean(axis=1) / lrd


@pytest.mark.parametrize("block,fan", [(10, 3), (40, 8), (1000, 4)])
def test_against_brute_force(spark, block, fan):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.5, (40, 3)), [[20, 20, 20], [4, 4, 4]]])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    near = nearest_neighbours(df, "id", "x", 5, block=block, fan=fan).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
    assert {(r.id, r.other) for r in near} == want
    if block == 10:
        scored = local_outlier_factor(df, "id", "x", 5, block=block, fan=fan)
        got = {r.id: r.lof for r in scored.collect()}
        assert np.allclose([got[i] for i in range(len(x))], brute_lof(x, 5))
        flagged = {r.id for r in flag_outliers(scored, 0.02).collect() if r.is_anomaly}
        assert 100 in flagged and 101 in flagged


def test_copies(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)] + [(100 + i, [float(i), 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    near = nearest_neighbours(df, "id", "x", 3, block=8, fan=4)
    assert near.groupBy("id").count().filter("count <> 3").count() == 0
    assert near.filter("id < 30 AND dist > 0").count() == 0


def test_visits_of_a_point_do_not_grow_with_the_leaves(spark):
    """Four times the clusters are four times the leaves; a point still goes to those around it only."""
    rng = np.random.default_rng(4)
    share = []
    for clusters in (20, 80):
        centres = rng.uniform(0, 1000, (clusters, 2))
        x = np.vstack([c + rng.normal(0, 0.1, (30, 2)) for c in centres])
        df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
        placed, nodes = pivot_tree(df, 40, 4, 3)
        assert placed.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 40
        assert nodes.filter("leaf").count() >= 0.6 * clusters
        visits = leaf_visits(placed.withColumn("bound", F.lit(0.3)), nodes, 12)
        share.append(visits.count() / len(x))
    assert share[1] < 2 * max(share[0], 0.5)


@pytest.mark.parametrize("spread,offset", [(1.0, 0.0), (1e-3, 50.0)])
def test_nearest_rows_need_few_differences(monkeypatch, spread, offset):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(offset, spread, (400, 16)), np.full((3, 16), offset)])
    left_out = np.eye(len(x), dtype=bool)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[left_out] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :5]

    def refuse(a, b):
        raise AssertionError("all distances by differences")

    monkeypatch.setattr(neighbours, "_distances", refuse)
    row, col, dist = neighbours._nearest(x, x, left_out, 5)
    assert (col.reshape(-1, 5) == order).all() and (row.reshape(-1, 5) == np.arange(len(x))[:, None]).all()
    assert (dist.reshape(-1, 5) == np.take_along_axis(d, order, axis=1)).all()


def test_nearest_rows_with_holes():
    x = np.random.default_rng(6).normal(0, 1, (60, 4))
    x[7, 2] = np.nan
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[np.eye(60, dtype=bool)] = np.inf
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    row, col, _ = neighbours._nearest(x, x, np.eye(60, dtype=bool), 5)
    assert (col.reshape(-1, 5) == order).all()


def rows_of(x: np.ndarray, ids) -> list:
    return [(int(i), None if row is None else [float(v) for v in row]) for i, row in zip(ids, x, strict=True)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_leaves_ask_for_their_points_together(spark, monkeypatch, kind):
    """Where nearly every leaf has to be visited, the tree is descended once a leaf and not once a point."""
    monkeypatch.setattr(neighbours, "HOME_BYTES", 8 * 12 * 60, raising=False)
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 8 * 12 * 90, raising=False)
    asked, visits = [], neighbours.leaf_visits
    monkeypatch.setattr(neighbours, "leaf_visits", lambda asking, *rest: asked.append(asking.count()) or visits(asking, *rest))
    x = np.random.default_rng(7).normal(0, 1, (300, 12)).astype("float32" if kind == "float" else "float64").astype("float64")
    ids = np.arange(300) // 2  # every id twice, with different vectors
    df = spark.createDataFrame(rows_of(x, ids), f"id long, x array<{kind}>")
    got = sorted((r.id, r.dist, r.other) for r in nearest_neighbours(df, "id", "x", 5, block=30, fan=4).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = []
    for i in range(150):
        pairs = [(d[r, c], int(ids[c])) for r in (2 * i, 2 * i + 1) for c in range(300) if ids[c] != i]
        want += [(i, *pair) for pair in sorted(pairs)[:5]]
    assert got == sorted(want)
    assert asked and asked[0] < 100


def test_rows_without_a_vector_take_no_part(spark):
    x = [*np.random.default_rng(8).normal(0, 1, (40, 2))]
    holes = [None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0]]
    rows = rows_of(x, range(40)) + [(100 + i, hole) for i, hole in enumerate(holes)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {(r.id, r.other) for r in nearest_neighbours(df, "id", "x", 3, block=10, fan=3).collect()}
    d = np.sqrt(((np.array(x)[:, None] - np.array(x)[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j)) for i in range(40) for j in np.argsort(d[i], kind="stable")[:3]}


def leaf_of(x: np.ndarray, ids: np.ndarray, k: int):
    centre, far = neighbours._ball(x)
    free = np.full((len(x), k), np.inf)
    return neighbours._Leaf("", 0, ids, np.ones(len(x), bool), x, centre, far, free, np.zeros((len(x), k), "int64"), np.zeros((len(x), k), "int8"))


@pytest.mark.parametrize("spread,offset,scale", [(1.0, 0.0, 1.0), (1e-3, 50.0, 1.0), (1e-7, 1.0, 1.0), (1.0, 0.0, 1e-200), (1.0, 0.0, 1e200), (0.0, 3.0, 1.0)])
def test_search_in_other_leaves_is_exact(spread, offset, scale):
    """Points of two scales, copies among them; what single precision can't tell apart is compared by differences."""
    rng = np.random.default_rng(9)
    x = rng.normal(offset, spread, (500, 8))
    x[250:] += rng.normal(0, 1, (250, 8)) * (spread > 0)
    x[100:120], x[400:410] = x[0], x[300]
    x *= scale
    with np.errstate(over="ignore", under="ignore"):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    d[~np.isfinite(d)] = np.inf
    np.fill_diagonal(d, np.inf)
    leaves = [leaf_of(x[i::5], np.arange(500)[i::5], 4) for i in range(5)]
    for i, leaf in enumerate(leaves):
        neighbours._compare(leaf, leaf.x, np.arange(100), leaf.x, leaf.ids, leaf.known)
        neighbours._search(leaf, leaves[:i] + leaves[i + 1 :])
        assert (leaf.dist == np.sort(d[leaf.ids], axis=1)[:, :4]).all()
        told = np.isfinite(leaf.dist)
        assert (np.take_along_axis(d[leaf.ids], leaf.other, axis=1)[told] == leaf.dist[told]).all()


def test_points_of_one_key_and_vector_are_dealt_out(spark):
    """No hash parts rows that are equal in all; a leaf stays bounded."""
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 50 + [(i, [float(i), 0.0]) for i in range(10, 20)], "id long, x array<double>")
    placed, _ = pivot_tree(df, 20, 4, 3)
    sizes = [r["count"] for r in placed.groupBy("leaf").count().collect()]
    assert sum(sizes) == 60 and max(sizes) <= 20
