"""Nearest neighbours, support vectors and perceptrons against plain ones on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import neighbours, packed, perceptron, support


def near_plain(ids, x, k, part=None):
    out = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        others = [j for j in range(len(ids)) if (part[j] != part[i] if part is not None else j != i)]
        for rank, j in enumerate(sorted(others, key=lambda j: (d[j], ids[j]))[:k], 1):
            out.add((ids[i], rank, ids[j], round(float(d[j]), 9)))
    return out


@pytest.mark.parametrize("parts", [False, True])
@pytest.mark.parametrize("pivots, chunk", [(1, 7), (12, 20), (64, 1024)])
def test_nearest_of_crowded_and_lonely_points(spark, monkeypatch, parts, pivots, chunk):
    """Clusters of equal points, far points, ties on a grid; chunks so small that a cell is many tasks."""
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros((60, 2)), rng.integers(0, 4, (90, 2)), rng.normal(size=(80, 2)) * 0.01 + 7, [[1e6, 0], [-1e6, 3]]]).astype(float)
    ids = [f"p{k:03d}" for k in rng.permutation(len(x))]
    part = rng.integers(0, 3, len(x))
    rows = [(i, v.tolist(), float(k), int(p)) for k, (i, v, p) in enumerate(zip(ids, x, part, strict=True))]
    df = spark.createDataFrame([*rows, (None, [0.0, 0.0], 1.0, 0), ("none", None, 1.0, 0)], "id string, x array<double>, value double, part int").repartition(6)
    got = neighbours.k_nearest(df, 4, "part" if parts else None, pivots).collect()
    assert {(r["id"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in got} == near_plain(ids, x, 4, part if parts else None)
    value = dict(zip(ids, range(len(ids)), strict=True))
    assert all(r["value"] == value[r["neighbour"]] for r in got)


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([(k, [float(k)], 0.0) for k in range(3)], "id long, x array<double>, value double")
    assert {(r["id"], r["rank"], r["neighbour"]) for r in neighbours.k_nearest(df, 5).collect()} == {(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)}
    assert neighbours.k_nearest(df.filter("id < 0"), 5).count() == 0


def test_equal_points_are_searched_once(spark):
    """Many copies of a few points: chunks meet sites and their smallest ids, not all pairs of copies."""
    rows = [(k, [float(k % 4), 0.0], float(k), k % 3) for k in range(6000)]
    df = spark.createDataFrame(rows, "id long, x array<double>, value double, part int")
    sites, near = neighbours._near_sites(df, 5, True, None)
    assert sites.count() == 12 and near.count() == 60
    got = {}
    for r in neighbours.k_nearest(df, 5, "part").filter("id in (0, 5999)").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    for i, found in got.items():
        others = sorted((abs(k % 4 - i % 4), k) for k in range(6000) if k % 3 != i % 3)[:5]
        assert sorted(found) == [(r, k, float(d)) for r, (d, k) in enumerate(others, 1)]
    assert len(got) == 2


def test_most_cells_are_not_searched():
    """The bounds hold for each point's true neighbours and spare most cells."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2)) * 3
    pivots = x[:50]
    d = neighbours.distances(x, pivots)
    cell, own = d.argmin(1), d.min(1)
    least = np.full((50, 6), np.inf)
    for c in range(50):
        inside = np.sort(own[cell == c])[:6]
        least[c, : len(inside)] = inside
    low = np.array([own[cell == c].min() for c in range(50)])
    high = np.array([own[cell == c].max() for c in range(50)])
    looked = neighbours.search(x, cell, np.zeros(len(x), int), pivots, {0: (low, high, least)}, 6)
    for i in range(0, 3000, 50):
        nearest = np.argsort(((x - x[i]) ** 2).sum(1))[:6]
        assert looked[i, cell[nearest]].all()
    assert looked.mean() < 0.4


def dealt(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 0]
    y = np.sin(x[:, 0] * 1.5) + 0.3 * x[:, 1] + rng.normal(size=n) * 0.1
    x[::37, 2] = np.nan
    rows = [(f"r{k}", f"g{k % 60}", float(y[k]), k % 60 % 3, *[None if np.isnan(v) else float(v) for v in x[k]]) for k in range(n)]
    return spark.createDataFrame(rows, "row_id string, grp string, y double, fold int, a double, b double, c double").repartition(4), x, y


def standard(x):
    x = x.copy()
    for c in range(x.shape[1]):
        known = np.sort(x[~np.isnan(x[:, c]), c])
        x[np.isnan(x[:, c]), c] = known[(len(known) + 1) // 2 - 1]
    return (x - x.mean(0)) / x.std(0)


def test_knn_regressor(spark):
    df, x, y = dealt(spark, 300)
    z, fold = standard(x), np.arange(300) % 60 % 3
    got = {r["row_id"]: r["oof"] for r in neighbours.knn_cv(df, ["a", "b", "c"], 5).collect()}
    for i in range(300):
        d = np.sqrt(((z - z[i]) ** 2).sum(1))
        d[fold == fold[i]] = np.inf
        at = np.argsort(d)[:5]
        assert got[f"r{i}"] == pytest.approx(np.average(y[at], weights=1 / d[at]), abs=1e-6)


def objective(w, z, y, cost, epsilon):
    return 0.5 * w @ w + cost * np.maximum(0, np.abs(z @ w - y) - epsilon).sum()


def test_support_vectors_near_the_optimum(spark, monkeypatch):
    """Eight blocks; each fold's objective is within one per cent of plain descent on all its rows until nothing moves."""
    monkeypatch.setattr(support, "COSINES", 20)
    monkeypatch.setattr(packed, "BLOCK_ROWS", 80)
    df, x, y = dealt(spark, 480)
    z = support.lifted(standard(x), support.waves(3, 1 / 3, 0, 20))
    fold, cost, epsilon = np.arange(480) % 60 % 3, 0.5, 0.1
    w, out = support.svr(df, ["a", "b", "c"], 3, cost=cost, epsilon=epsilon, rounds=40, sweeps=3)
    rng = np.random.default_rng(5)
    for k in range(3):
        beta, best = np.zeros(480), np.zeros(21)
        for _ in range(400):
            best = best + support.descend(z, y, beta, best, fold != k, cost, epsilon, 1.0, rng.permutation(480))
        on = fold != k
        least = objective(best, z[on], y[on], cost, epsilon)
        dual = beta @ y - epsilon * np.abs(beta).sum() - 0.5 * best @ best
        assert least - dual < 0.01 * least  # the plain optimum is one: its dual gap is small
        assert objective(w[k], z[on], y[on], cost, epsilon) <= 1.01 * least
    got = {r["row_id"]: r["oof"] for r in out.collect()}
    assert [got[f"r{i}"] for i in range(480)] == pytest.approx([z[i] @ w[fold[i]] for i in range(480)])


def test_gradient_of_the_perceptron():
    rng = np.random.default_rng(0)
    layout = perceptron.shapes(4, (6, 5))
    theta, x, y = perceptron.begin(layout, 1), rng.normal(size=(30, 4)), rng.normal(size=30)
    _, slope = perceptron.loss_and_gradient(x, y, theta, layout)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        up, down = (perceptron.loss_and_gradient(x, y, theta + s, layout)[0] for s in (step, -step))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-3, rel=1e-4)


def test_perceptron_learns_and_stops_on_groups_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_ROWS", 70)
    df, x, y = dealt(spark, 600)
    flagged = perceptron.stopping_groups(df, 3, 0.12, "0").collect()
    for k in range(3):
        stop = {r["grp"] for r in flagged if r["stop"] >> k & 1}
        train = {r["grp"] for r in flagged if not r["stop"] >> k & 1 and r["fold"] != k}
        held = {r["grp"] for r in flagged if r["fold"] == k}
        assert stop and train and not stop & train and not stop & held and not train & held
    theta, out = perceptron.mlp(df, ["a", "b", "c"], 3, hidden=(16,), passes=60)
    got = {r["row_id"]: r["oof"] for r in out.collect()}
    r2 = 1 - sum((got[f"r{i}"] - y[i]) ** 2 for i in range(600)) / ((y - y.mean()) ** 2).sum()
    assert r2 > 0.8 and len(theta) == 3


def test_quasi_newton_finds_the_least_of_a_quadratic():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(12, 12))
    a = a @ a.T + np.eye(12)
    b = rng.normal(size=12)
    fit = perceptron._Fit(np.zeros(12), 0.0, 1000)
    for _ in range(200):
        if not fit.done:
            loss = 0.5 * fit.at @ a @ fit.at - b @ fit.at
            fit.told(float(loss), a @ fit.at - b, float(loss))
    assert fit.best[1] == pytest.approx(np.linalg.solve(a, b), abs=1e-4)


def test_sums_of_arrays(spark):
    parts = [np.arange(5.0) * k for k in range(40)]
    df = spark.createDataFrame([(p.tobytes(),) for p in parts], "s binary")
    assert packed.summed(df, "s").tolist() == sum(parts).tolist()
    assert len(packed.summed(df.filter(F.lit(False)), "s")) == 0


def test_support_vectors_of_many_blocks_at_once_are_those_of_each_alone():
    """rows of several blocks are taken in turn together; a block's duals and additions are those of descend()."""
    rng = np.random.default_rng(3)
    sizes, folds, most = (7, 5, 9), 3, 9
    z, y, fold = np.zeros((3, most, 4)), np.zeros((3, most)), np.full((3, most), -2.0)
    order = np.tile(np.arange(most), (3, folds, 1))
    for b, n in enumerate(sizes):
        z[b, :n], y[b, :n], fold[b, :n] = rng.normal(size=(n, 4)), rng.normal(size=n), rng.integers(0, 3, n)
        for k in range(folds):
            order[b, k, :n] = rng.permutation(n)
    beta, w = np.zeros((3, folds, most)), rng.normal(size=(3, folds, 4))
    added = support.descend_blocks(z, y, beta, w, fold, 0.5, 0.1, 3.0, order)
    for b, n in enumerate(sizes):
        for k in range(folds):
            own = np.zeros(n)
            alone = support.descend(z[b, :n], y[b, :n], own, w[b, k], fold[b, :n] != k, 0.5, 0.1, 3.0, order[b, k, :n])
            assert added[b, k] == pytest.approx(alone) and beta[b, k, :n] == pytest.approx(own)
