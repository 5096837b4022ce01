"""What must not grow faster than the tables: crowded points, equal rows, copies of joins."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainmill.operators import geometry as ge
from grainmill.operators import ml, neighbours


def crowd(spark, n=300, builds=2):
    rng = np.random.default_rng(7)
    rows = [(b, 1000 * b + i, "ONHCX"[i % 5], *map(float, p)) for b in range(builds) for i, p in enumerate(rng.normal(size=(n, 3)).round(2))]
    return spark.createDataFrame([*rows, (0, 9000, "O", None, 0.0, 0.0), (0, 9001, "O", float("nan"), 0.0, 0.0)], "build_id int, i long, symbol string, x double, y double, z double").repartition(4)


def test_triangles_of_a_crowd_do_not_shuffle_bonds(spark, monkeypatch):
    """the same triangles as by joins of bonds, from groups of atoms; neither bonds nor triangles are shuffled."""
    monkeypatch.setattr(ge, "HOME", 16)
    monkeypatch.setattr(ge, "ROOM", 50)
    radii, atoms = {"O": 0.3, "N": 0.35, "H": 0.15, "C": 0.4}, crowd(spark)
    found = ge.close_triangles(atoms, radii, 0.1)
    want = {tuple(r) for r in ge.triangles(ge.bonds(atoms, radii, 0.1).select("build_id", "i", "j")).collect()}
    assert len(want) > 1000 and len(got := [tuple(r) for r in found.collect()]) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_triangles_take_a_distance_once_a_group(spark, monkeypatch):
    """F1 of r04: a group takes the distance of two atoms once, not for each atom that both are bonded to; its triangles are rows as they leave it."""
    monkeypatch.setattr(ge, "ROOM", 4000)
    radii, atoms, taken = {"O": 0.3, "N": 0.35, "H": 0.15, "C": 0.4}, crowd(spark, 200, 1), []
    found = ge.close_triangles(atoms, radii, 1.5)
    want = {tuple(r) for r in ge.triangles(ge.bonds(atoms, radii, 1.5).select("build_id", "i", "j")).collect()}
    assert len(want) > 50_000 and len(got := [tuple(r) for r in found.collect()]) == len(want) and set(got) == want
    rows = [(1000 + i, x, 0.0, 0.0, 0.3, i < 8) for i, x in enumerate(np.linspace(0, 1, 150).tolist())]
    near = spark.createDataFrame([(0, *r) for r in rows], "build_id int, i long, x double, y double, z double, r double, home boolean")
    solve, own = [], ge._Group.apart
    monkeypatch.setattr(ge._Group, "apart", lambda g, one, two: taken.append(len(one) * len(two)) or own(g, one, two))
    monkeypatch.setattr(ge, "surroundings", lambda *a: (near, ["build_id"]))
    monkeypatch.setattr(type(near.groupBy("build_id")), "applyInArrow", lambda by, f, schema: solve.append(f) or near)
    ge.close_triangles(atoms, radii, 1.5)
    batch = pa.RecordBatch.from_pydict(dict(zip(("i", *"xyz", "r", "home"), map(list, zip(*rows, strict=True)), strict=True)))
    out = list(solve[0]((pa.scalar(0),), iter([batch])))
    assert sum(b.num_rows for b in out) == sum((149 - a) * (148 - a) // 2 for a in range(8)) and max(b.num_rows for b in out) < 2 * 4000
    assert sum(taken) < 150 * 150


@pytest.mark.parametrize("name", ["gbt", "rf"])
def test_trees_on_sums_of_equal_rows(spark, monkeypatch, name):
    """trees see a row for each different one of the features, and predict as those fitted on all rows do, missing values and clipped targets too."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 6, 1200), rng.integers(0, 5, 1200)
    rows = [(f"r{i}", f"g{i % 40}", None if i % 50 == 7 else float(a[i]), float(b[i]), float(a[i] * (b[i] > 2) + 0.1 * rng.normal() - 9 * (i % 90 == 0))) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id string, grp string, a double, b double, y double").repartition(4)
    fitted, own = [], ml.make_model

    def watched(*args, **params):
        model = own(*args, **params)
        fit = model.fit
        model.fit = lambda data: fitted.append(data.count()) or fit(data)
        return model

    params = {"maxIter": 3} if name == "gbt" else {"numTrees": 4}
    monkeypatch.setattr(ml, "make_model", watched)
    got = {r["row_id"]: (r["y"], r["oof"]) for r in ml.grouped_cv(df, name, ["a", "b"], folds=2, clip=1.0, **params).collect()}
    assert len(fitted) == (2 if name == "gbt" else 8) and max(fitted) <= 36
    monkeypatch.setattr(ml, "make_model", own)
    monkeypatch.setattr(ml, "CROWDED", 10**9)
    want = {r["row_id"]: (r["y"], r["oof"]) for r in ml.grouped_cv(df, name, ["a", "b"], folds=2, clip=1.0, **params).collect()}
    assert set(got) == set(want) and all(got[r][0] == want[r][0] for r in want)
    off = np.array([got[r][1] - want[r][1] for r in want])
    assert abs(off).max() < 1e-9 if name == "gbt" else np.sqrt((off**2).mean()) < 0.5


def test_bond_changes_of_a_crowd_do_not_shuffle_bonds(spark, monkeypatch):
    """counts as by joins of both lists of bonds; only atoms and counts of groups are shuffled."""
    monkeypatch.setattr(ge, "HOME", 16)
    monkeypatch.setattr(ge, "ROOM", 500)
    radii, atoms = {"O": 0.3, "N": 0.35, "H": 0.15, "C": 0.4}, crowd(spark)
    for before, after in ((0.1, 0.3), (0.3, 0.1)):
        want = {tuple(r) for r in ge.bond_changes(ge.bonds(atoms, radii, before), ge.bonds(atoms, radii, after)).collect()}
        found = ge.slack_changes(atoms, radii, before, after)
        assert {tuple(r) for r in found.collect()} == want and len(want) == 2
    assert dict(found.dtypes) == {"build_id": "int", "made": "bigint", "broken": "bigint"}


def test_nearest_rows_by_products(monkeypatch):
    """the same rows, order and distances as by differences of all pairs: ties, equal rows, large offsets, values that are not finite, barred pairs."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(neighbours, "BLOCK", 3000)
    grid = rng.integers(0, 3, (90, 4)).astype(float)
    odd = rng.normal(size=(60, 4))
    odd[3, 1], odd[9, 2] = np.inf, np.nan
    for a, b in ((grid, grid), (rng.normal(size=(70, 16)), rng.normal(size=(200, 16))), (1e6 + 1e-3 * grid, 1e6 + 1e-3 * grid[:50]), (odd, odd), (grid[:3], grid[:2]), (1e200 + grid, 1e200 + grid)):
        of, to = np.arange(len(a)) % 3, np.arange(len(b)) % 3
        for barred in (None, lambda r, c, of=of, to=to: of[r][:, None] == to[c][None]):
            with np.errstate(invalid="ignore"):
                d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
            if barred:
                d[of[:, None] == to[None]] = np.inf
            at = np.argsort(d, axis=1, kind="stable")[:, :5]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(d, at, 1)))
            got = neighbours.nearest(a, b, 5, barred)
            assert got[0].tolist() == row.tolist() and got[1].tolist() == at[row, col].tolist() and got[2].tolist() == pytest.approx(d[row, at[row, col]].tolist(), rel=1e-14)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.find("== Initial Plan ==")].count("Exchange hashpartitioning")


def test_ordered_pairs_shuffle_small_blocks_once(spark):
    """small blocks are paired where their rows lie; with larger ones beside them the same pairs come out."""
    from grainmill.operators import cells

    rows = [(f"b{i % 23}", f"r{i}", float(i * i % 101)) for i in range(150)]
    small = spark.createDataFrame(rows, "blk string, row_id string, v double").repartition(4)
    every = small.unionByName(spark.createDataFrame([("big", f"x{i}", float(i)) for i in range(40)], small.schema))
    by = lambda df: df.select("blk", F.col("row_id").alias("id"), "v", F.col("row_id").alias("_o0"))
    for df in (small, every):
        got = sorted(tuple(r) for r in cells.ordered_pairs(df, "v", 12).collect())
        assert got == sorted(tuple(r) for r in cells._pairs_of_any(by(df), 12, ("_o0",)).collect()) and len(got) >= 23 * 12
    assert exchanges(cells.ordered_pairs(small, "v", 12)) == 1


def test_features_are_shuffled_in_all_folds_at_once(spark):
    """the values that permuted() gives fold by fold, from one place a row and feature."""
    from grainmill.operators.resampling import permuted

    df = spark.range(300).select(F.concat(F.lit("r"), F.col("id")).alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), F.col("id").cast("double").alias("y"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 29).cast("double").alias("b"))
    got = {(r["fold"], r["y"]): (r["_m_a"], r["_m_b"]) for r in ml.permuted_in_folds(df, ["a", "b"], "5").collect()}
    want = {}
    for k in range(3):
        for c in ("a", "b"):
            for r in permuted(df.filter(F.col("fold") == k), "row_id", c, f"5|{c}", []).collect():
                want.setdefault((k, r["y"]), []).append(r[f"{c}_shuffled"])
    assert got == {k: tuple(v) for k, v in want.items()} and len(got) == 300


def test_partitions_grow_with_the_rows(spark, sf_dir, monkeypatch):
    """more rows than the session's partitions should take are dealt into more of them, with the same results; small tables are left as they are."""
    from grainmill.functions import joins
    from grainmill.plans import catalog, registry

    names, old = ("p23_seed_ensemble", "a13_series_order", "p26_antisymmetric_model"), spark.range(5)
    assert joins.spread(old, 8 * joins.ROWS_A_TASK, "id") is old and joins.spread(old, 8 * joins.ROWS_A_TASK + 1, "id").rdd.getNumPartitions() == 9
    before = {n: sorted(tuple(r) for r in catalog.QUERIES[n](spark, sf_dir).collect()) for n in names}
    monkeypatch.setattr(joins, "ROWS_A_TASK", 400)
    assert registry.measures(spark, sf_dir).rdd.getNumPartitions() == 15
    for n in names:
        for got, want in zip(sorted(tuple(r) for r in catalog.QUERIES[n](spark, sf_dir).collect()), before[n], strict=True):
            assert got == pytest.approx(want, abs=2e-6)
