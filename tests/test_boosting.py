"""The boosters against plain ones that grow one leaf at a time on whole arrays."""

import hashlib
from dataclasses import replace

import numpy as np
import pytest

from grainmill.operators import boosting
from grainmill.operators.boosting import Boosting

MISSING_SHARE = 0.15


def hash32(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)


def table(n=900, seed=3):
    """Rows with a step, a slope and an interaction, missing values that matter, and a fold."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.2
    gone = rng.random((n, 3)) < MISSING_SHARE
    y[gone[:, 1]] += 1.5
    x[gone] = np.nan
    return x, y.round(4), np.arange(n) % 3


def frame(spark, x, y, fold):
    rows = [(f"r{k}", f"g{k % 40}", float(y[k]), int(fold[k]), *[None if np.isnan(v) else float(v) for v in x[k]]) for k in range(len(y))]
    return spark.createDataFrame(rows, "row_id string, grp string, y double, fold int, a double, b double, c double").repartition(5)


def gain_of(g, n, p):
    return g * g / (n + p.l2) if n + p.l2 else 0.0


def best_split(bins, g, on, p):
    best, missing = None, p.bins
    for f in range(bins.shape[1]):
        for b in range(p.bins):
            for to_left in (False, True):
                left = on & ((bins[:, f] <= b) | (to_left & (bins[:, f] == missing)))
                right = on & ~left
                if min(left.sum(), right.sum()) < max(1, p.least_rows) or not (on & (bins[:, f] == b)).any() and b and best and best[1:3] == (f, b - 1):
                    continue
                gain = round(gain_of(g[left].sum(), left.sum(), p) + gain_of(g[right].sum(), right.sum(), p) - gain_of(g[on].sum(), on.sum(), p), 9)
                if gain > p.gamma and (best is None or gain > best[0] + 1e-7):
                    best = (gain, f, b, left, right)
    return best


def grow(bins, g, train, p):
    """Masks of the leaves, over all rows, and of their training rows: the leaf with the highest gain is split next."""
    everyone = np.ones(len(g), bool)
    leaves = [(everyone, 0, best_split(bins, g, train, p))]
    while len(leaves) < p.leaves:
        k = max(range(len(leaves)), key=lambda k: leaves[k][2][0] if leaves[k][2] and leaves[k][1] < p.depth else -1)
        mask, depth, split = leaves[k]
        if not split or depth >= p.depth:
            break
        # the split's training sides tell where missing values went; rows outside training follow the same test
        _, f, b, left, _ = split
        to_left = bool((left & (bins[:, f] == p.bins)).any())
        side = mask & ((bins[:, f] <= b) | (to_left & (bins[:, f] == p.bins)))
        other = mask & ~side
        leaves[k : k + 1] = [(m, depth + 1, best_split(bins, g, m & train, p)) for m in (side, other)]
    return [m for m, _, _ in leaves]


def plain(x, y, fold, cuts, p, k):
    """Predictions of fold k's model for all rows."""
    bins = np.stack([np.where(np.isnan(x[:, f]), p.bins, np.searchsorted(cuts[f], x[:, f], side="left")) for f in range(x.shape[1])], axis=1)
    train, trees = fold != k, []
    base = y[train].mean()
    for number in range(p.trees):
        dropped = [t for t in range(number) if hash32(f"{p.seed}|drop|{number}|{t}") < p.drop * (1 << 32)]
        now = base + sum((v * s for t, (v, s) in enumerate(trees) if t not in dropped), np.zeros(len(y)))
        g = np.where(train, now - y, 0)
        value = np.zeros(len(y))
        for m in grow(bins, g, train, p):
            value[m] = -p.rate * g[m].sum() / ((m & train).sum() + p.l2)
        for t in dropped:
            trees[t] = (trees[t][0], trees[t][1] * len(dropped) / (len(dropped) + 1))
        trees.append((value, 1 / (len(dropped) + 1)))
    return base + sum(v * s for v, s in trees)


CASES = {
    "leafwise": Boosting(trees=6, leaves=6, depth=4, bins=8, least_rows=15, rate=0.3),
    "levels": Boosting(trees=3, leaves=16, depth=3, bins=6, least_rows=1, l2=0.0, rate=0.5),
    "dart": Boosting(trees=11, leaves=4, depth=3, bins=6, least_rows=10, rate=0.4, drop=0.4),
    "no_split": Boosting(trees=2, leaves=4, depth=2, bins=6, gamma=1e9),
}


@pytest.mark.parametrize("name", CASES)
def test_folds_against_plain_boosting(spark, monkeypatch, name):
    """Blocks of few rows, writes every other tree, three folds at once."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "EVERY", 2)
    p, (x, y, fold) = CASES[name], table()
    model, out = boosting.boost(frame(spark, x, y, fold), ["a", "b", "c"], p, 3)
    got = {r["row_id"]: r["oof"] for r in out.collect()}
    want = np.stack([plain(x, y, fold, model.cuts, p, k) for k in range(3)])
    assert len(got) == len(y)
    r2 = lambda v: 1 - ((y - v) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    mine, plainly = np.array([got[f"r{k}"] for k in range(len(y))]), want[fold, np.arange(len(y))]
    assert mine == pytest.approx(plainly, abs=1e-6)
    assert name == "no_split" or r2(mine) > 0.5


def test_ordered_symmetric(spark):
    """One split a level, and every row's own target left out of the trees that reach it: changing one target moves no leaf value that the row meets."""
    p, (x, y, fold) = replace(boosting.LEARNERS["catboost"], trees=3, depth=2, bins=8), table(400)
    fold[:] = -1
    model, out = boosting.boost(frame(spark, x, y, fold), ["a", "b", "c"], p)
    for trees in model.trees:
        t = trees[0]
        inner = np.flatnonzero(t.feature >= 0)
        level = {0: 0}
        for k in inner:
            level[t.left[k]] = level[t.right[k]] = level[k] + 1
        for d in range(p.depth):
            assert len({(t.feature[k], t.bin[k]) for k in inner if level[k] == d}) <= 1
    first = model.trees[0][0]
    bins = np.stack([np.where(np.isnan(x[:, f]), p.bins, np.searchsorted(model.cuts[f], x[:, f], side="left")) for f in range(3)], axis=1)
    leaf, g = first.leaves(bins, p.bins), y.mean() - y
    segment = np.array([hash32(f"{p.seed}|r{k}") % p.segments for k in range(len(y))])
    for s in range(p.segments + 1):
        for i in range(len(first.value)):
            on = (leaf == i) & (segment < s)
            assert first.value[i, s] == pytest.approx(-p.rate * g[on].sum() / (on.sum() + p.l2), abs=1e-9)
    total = {r["row_id"]: r["oof"] for r in out.collect()}
    one = boosting.boost(frame(spark, x, y, fold), ["a", "b", "c"], replace(p, trees=1))[1].collect()
    assert {r["row_id"]: r["oof"] for r in one} == pytest.approx({f"r{k}": y.mean() + first.value[leaf[k], segment[k]] for k in range(len(y))}) and len(total) == len(y)


def test_model_predicts_new_rows(spark):
    x, y, fold = table(500)
    df = frame(spark, x, y, fold).drop("fold")
    model = boosting.fit(df, ["a", "b", "c"], Boosting(trees=5, leaves=6, depth=3, bins=16))
    got = {r["row_id"]: r["prediction"] for r in model.predict(df).collect()}
    assert model.predict(df).columns == [*df.columns, "prediction"]
    fold[:] = -1
    want = plain(x, y, fold, model.cuts, model.p, 0)
    assert [got[f"r{k}"] for k in range(len(y))] == pytest.approx(want, abs=1e-6)


def test_weights_equal_copies(spark):
    x, y, fold = table(300)
    p = Boosting(trees=3, leaves=5, depth=3, bins=8, least_rows=0, least_hessian=10)
    df = frame(spark, x, y, fold)
    from pyspark.sql import functions as F

    heavy = F.when(F.col("a") > 0, 3).otherwise(1)
    model, out = boosting.boost(df.withColumn("w", heavy), ["a", "b", "c"], p, 3, "w")
    copies = df.withColumn("k", F.explode(F.sequence(F.lit(1), heavy))).withColumn("row_id", F.concat_ws("#", "row_id", "k"))
    again, other = boosting.boost(copies, ["a", "b", "c"], p, 3)
    if model.cuts == again.cuts:  # quantiles of copies may lie elsewhere
        want = {r["row_id"].split("#")[0]: r["oof"] for r in other.collect()}
        assert {r["row_id"]: r["oof"] for r in out.collect()} == pytest.approx(want, abs=1e-9)
    assert model.base == pytest.approx(again.base)


def test_ordered_statistic(spark, monkeypatch):
    """A frequent category over many bins, a category of one row, null, ties of the hash left to the row's name."""
    monkeypatch.setattr(boosting, "BIN_BITS", 4)
    rows = [(f"r{k}", None if k % 10 == 0 else "hot" if k % 3 else f"c{k % 40}", float((k * 37) % 101)) for k in range(600)]
    got = {r["row_id"]: r["encoded"] for r in boosting.ordered_statistic(spark.createDataFrame(rows, "row_id string, c string, y double"), "c", prior=2.0).collect()}
    mean = sum(y for *_, y in rows) / len(rows)
    seen, want = {}, {}
    for r, c, y in sorted(rows, key=lambda x: (hash32(f"0|{x[0]}"), x[0])):
        own = seen.setdefault(c, [])
        want[r] = (sum(own) + 2 * mean) / (len(own) + 2)
        own.append(y)
    assert got == pytest.approx(want)


def test_blocks_hold_each_row_of_bins_once_and_no_leaves(spark):
    """a block keeps nothing by row and tree, and passes read no names."""
    df = spark.range(400).selectExpr("cast(id as string) row_id", "cast(id % 20 as string) grp", "cast(id % 5 as double) y", "cast(id % 3 as int) fold", "cast(id % 4 as double) a", "cast(id % 2 as double) b")
    assert not {"leaves", "ids", "grp"} & set(boosting.ARRAYS)
    p = Boosting(trees=3, drop=0.5, bins=8)
    rows = boosting._blocks(df.coalesce(1), ["a", "b"], [[0.0, 1.0, 2.0], [0.0]], p, 3, [0.0] * 3, None).collect()
    assert sum(len(np.frombuffer(r["bins"], np.uint16)) for r in rows) == 2 * 4 * len(rows)  # (a, b) has four values
    assert sum(len(np.frombuffer(r["which"], "i4")) for r in rows) == 400
