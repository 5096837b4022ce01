"""Closed forms, invariants and literal versions of the operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainmill.functions import scalars as sc
from grainmill.operators import cells as ce
from grainmill.operators import geometry as ge
from grainmill.operators import metrics as me
from grainmill.operators import predict as pr
from grainmill.operators import registry as xr
from grainmill.operators import relational as re_
from grainmill.operators import resampling as rs


@pytest.fixture(scope="module")
def study():
    """12 groups x 2 coarse x 2 exact blocks x 3 indices, seeded."""
    rng = np.random.default_rng(0)
    rows = []
    for g in range(12):
        for b in range(2):
            for s in range(2):
                for i in (3, 4, 6):
                    y = rng.normal() + g
                    rows.append((f"r{g}{b}{s}{i}", f"g{g}", f"g{g}||{b}", f"g{g}||{b}||{s}", i, y, y + rng.normal()))
    return pd.DataFrame(rows, columns=["row_id", "grp", "blk", "strict_blk", "idx", "y", "p"])


def literal_pairs(df, block):
    c = df.groupby(["grp", block, "idx"])[["y", "p"]].mean().reset_index()
    out = []
    for (g, b), rows in c.groupby(["grp", block]):
        rows = rows.sort_values("idx")
        for k in range(len(rows) - 1):
            a, z = rows.iloc[k], rows.iloc[k + 1]
            if z.idx - a.idx == 1:
                out.append((g, b, a.idx, a.y - z.y, a.p - z.p))
    return pd.DataFrame(out, columns=["grp", "blk", "lo", "dy", "dp"])


def pairs_of(spark, df, block="blk"):
    out = ce.adjacent(ce.collapse(spark.createDataFrame(df), ["y", "p"], block), ["y", "p"], block)
    return out.withColumnsRenamed({"d_y": "dy", "d_p": "dp"})


def test_gap_is_not_adjacent(spark, study):
    got = pairs_of(spark, study).toPandas()
    want = literal_pairs(study, "blk")
    assert set(got.lo) == {3} and len(got) == len(want)
    both = got.merge(want, on=["grp", "blk"])
    assert np.allclose(both.dy_x, both.dy_y) and np.allclose(both.dp_x, both.dp_y)


def test_window_and_join_forms_agree(spark, study):
    c = ce.collapse(spark.createDataFrame(study), ["y"])
    a, b = (f(c, ["y"]).select("blk", "lo", F.round("d_y", 9).alias("d")) for f in (ce.adjacent, ce.adjacent_by_join))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0


def test_perfect_prediction_and_block_constants(spark, study):
    exact = study.assign(p=study.y)
    assert me.pair_metrics(pairs_of(spark, exact)).first()["r2"] == pytest.approx(1)
    shifted = study.assign(p=study.p + study.blk.map({b: k * 3.7 for k, b in enumerate(study.blk.unique())}))
    a, b = (me.pair_metrics(pairs_of(spark, x)).first()["r2"] for x in (study, shifted))
    assert a == pytest.approx(b)


def test_differences_are_linear(spark, study):
    other = study.assign(p=study.p * 0.5 + 1)
    blend = study.assign(p=0.3 * study.p + 0.7 * other.p)
    a, b, c = (pairs_of(spark, x).toPandas().sort_values("blk").dp.to_numpy() for x in (study, other, blend))
    assert np.allclose(c, 0.3 * a + 0.7 * b)


def literal_bootstrap(pairs, drawn):
    out = {}
    for draw, rows in drawn.groupby("draw"):
        x = pd.concat([pairs[pairs.grp == g] for g, t in zip(rows.grp, rows.times, strict=True) for _ in range(t)])
        out[draw] = 1 - ((x.dy - x.dp) ** 2).sum() / ((x.dy - x.dy.mean()) ** 2).sum()
    return out


def test_bootstrap_from_moments_is_the_literal_one(spark, study):
    q = pairs_of(spark, study)
    by = rs.arm_moments(q)
    drawn = rs.draws(by, 8, "s")
    d = drawn.toPandas()
    assert (d.groupby("draw").times.sum() == 12).all()
    got = {r["draw"]: r["dp"] for r in rs.bootstrap_r2(by, drawn, ["dp"]).collect()}
    want = literal_bootstrap(q.toPandas(), d)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    collapsed = rs.draws(by, 8, "s", collapse=True).toPandas()
    assert (collapsed.times == 1).all() and len(collapsed) == len(d)


def test_each_group_once_is_the_plain_statistic(spark, study):
    q = pairs_of(spark, study)
    by = rs.arm_moments(q)
    once = by.select("grp", F.lit(0).alias("draw"), F.lit(1).alias("times"))
    assert rs.bootstrap_r2(by, once, ["dp"]).first()["dp"] == pytest.approx(me.pair_metrics(q).first()["r2"], abs=1e-9)


def test_logo_is_the_loop(spark, study):
    q = pairs_of(spark, study)
    pdf = q.toPandas()
    for r in pr.logo_slope(q, "dp").collect():
        x = pdf[pdf.grp != r["grp"]]
        assert r["k"] == pytest.approx((x.dp * x.dy).sum() / (x.dp**2).sum())
    for r in pr.logo_affine(rs.moments(q, "dy", ["dp"], ["grp"]), "dp").collect():
        x = pdf[pdf.grp != r["grp"]]
        b, a = np.polyfit(x.dp, x.dy, 1)
        assert (r["a"], r["b"]) == (pytest.approx(a), pytest.approx(b))
    for r in pr.logo_lookup(q, "lo").collect():
        assert r["lookup"] == pytest.approx(pdf[pdf.grp != r["grp"]].dy.mean())
    weights = [(1 - k / 4, k / 4) for k in range(5)]
    q2 = q.withColumn("dp2", -F.col("dp") * 0.3)
    pdf = q2.toPandas()
    for r in rs.nested_blend(rs.moments(q2, "dy", ["dp", "dp2"], ["grp"]), ["dp", "dp2"], weights).collect():
        x = pdf[pdf.grp != r["grp"]]
        errors = [((x.dy - w[0] * x.dp - w[1] * x.dp2) ** 2).sum() for w in weights]
        assert r["k"] == int(np.argmin(np.round(errors, 9)))


def test_lookup_falls_back_to_the_mean_of_others(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 3.0), ("c", 2, 5.0)], "grp string, lo int, dy double")
    got = {r["grp"]: r["lookup"] for r in pr.logo_lookup(df, "lo").collect()}
    assert got == {"a": 4.0, "b": 5.0, "c": 3.0}


def test_nnls_against_enumeration():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(50, 3))
    b = a @ [0.2, 0.0, 0.8]
    w = rs.nnls(a.T @ a, a.T @ b)
    assert w == pytest.approx([0.2, 0, 0.8], abs=1e-3)


def test_splits(spark):
    rng = np.random.default_rng(2)
    counts = [(f"g{k}", int(n)) for k, n in enumerate(rng.integers(0, 40, 60))]
    a, b = rs.even_split(counts)
    n = dict(counts)
    assert not set(a) & set(b) and set(a) | set(b) == set(n)
    share = sum(n[x] for x in a) / sum(n.values())
    assert 0.45 < share < 0.55
    parts = {r["grp"]: r["part"] for r in rs.snake_draft(spark.createDataFrame(counts, "grp string, n long"), "n").collect()}
    assert set(parts) == set(n)
    loads = [sum(n[g] for g, p in parts.items() if p == k) for k in range(3)]
    assert max(loads) - min(loads) < 80
    folds = rs.balanced_folds(counts, 5)
    assert set(folds) == set(n) and set(folds.values()) == set(range(5))
    strata = rs.stratified_folds([(g, s, c) for g, c in counts for s in "xy"], 4)
    assert set(strata) == set(n)


def test_hash_folds_are_balanced(spark, study):
    f = rs.hash_folds(spark.createDataFrame(study), 5, "7").groupBy("fold").count().toPandas()
    assert f["count"].max() - f["count"].min() <= 1 and f["count"].sum() == 12


def test_weights_average_to_one(spark, study):
    df = spark.createDataFrame(study)
    for scheme in ("none", "group_inv", "group_inv_full", "index_inv", "combo"):
        assert pr.row_weights(df, scheme).agg(F.avg("weight")).first()[0] == pytest.approx(1)
    assert pr.density_weights(df, "y").agg(F.avg("weight")).first()[0] == pytest.approx(1)
    assert pr.balanced_weights(df).agg(F.sum("weight")).first()[0] == pytest.approx(len(study))
    with pytest.raises(KeyError):
        pr.row_weights(df, "other")


def test_hot_groups_and_null_keys(spark):
    from grainmill.functions.joins import with_group

    rows = [(k, "hot" if k < 3000 else None if k < 3100 else f"g{k}", float(k)) for k in range(6000)]
    df = spark.createDataFrame(rows, "k int, grp string, v double")
    got = {r["k"]: (r["m"], r["n"]) for r in with_group(df, "grp", {"m": F.avg("v"), "n": F.count("*")}).collect()}
    assert len(got) == 6000 and got[5] == (1499.5, 3000) and got[3050] == (3049.5, 100) and got[4000] == (4000.0, 1)


def test_guards_raise(spark, study):
    df = spark.createDataFrame(study)
    ce.assert_nested(df)
    with pytest.raises(ValueError):
        ce.assert_nested(df.withColumn("blk", F.lit("one")))
    dim = spark.createDataFrame([("g1", 1)], "grp string, v int")
    with pytest.raises(ValueError):
        re_.total_join(df, dim, "grp", "v")
    with pytest.raises(ValueError):
        re_.covered_join(df, dim, "grp")
    with pytest.raises(KeyError):
        re_.row_filter(df, "nothing", {})
    with pytest.raises(KeyError):
        re_.preset(df, {"a": ["not there"]}, "a")
    few = spark.createDataFrame([("zz",)], "grp string")
    assert re_.overlap_join(df.select("grp").distinct(), few, "grp").count() == 0
    runs = spark.createDataFrame([("r", 1, 1.0), ("r", 1, 2.0)], "row_id string, seed int, oof double")
    with pytest.raises(ValueError):
        pr.seed_ensemble(runs, 1)
    with pytest.raises(ValueError):
        pr.seed_ensemble(runs.limit(1).withColumn("oof", F.lit(float("nan"))), 1)
    with pytest.raises(ValueError):
        xr.checked_cells(runs.withColumn("tag", F.lit("a")), ["row_id", "seed"], "tag", F.lit("a"))
    with pytest.raises(ValueError):
        xr.unchanged_preset({"a": ["x", "y"]}, {"a": ["y", "x"]}, "a")


def test_transitive_scores(spark):
    pairs = spark.createDataFrame([("k", 1, 2, 1.0), ("k", 2, 3, 2.0), ("k", 1, 3, 3.0), ("m", 1, 2, 4.0)], "k string, a int, b int, v double")
    got = {(r["k"], r["item"]): r["score"] for r in pr.transitive_scores(pairs, ["k"], "a", "b", "v").collect()}
    assert got["k", 1] - got["k", 2] == pytest.approx(1) and got["k", 2] - got["k", 3] == pytest.approx(2) and sum(got["k", i] for i in (1, 2, 3)) == pytest.approx(0)
    assert got["m", 1] == pytest.approx(2)


def test_interaction_of_equal_arms_is_zero(spark, study):
    q = pairs_of(spark, study).withColumns({f"dp{k}": F.col("dp") for k in (2, 3, 4)})
    by = rs.arm_moments(q, arms=("dp", "dp2", "dp3", "dp4"))
    b = rs.bootstrap_r2(by, rs.draws(by, 5, "x"), ["dp", "dp2", "dp3", "dp4"])
    assert all((r["dp"] - r["dp2"]) - (r["dp3"] - r["dp4"]) == 0 for r in b.collect())


def test_spearman_without_global_window(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"y": rng.integers(0, 50, 3000).astype(float), "p": rng.normal(size=3000).round(1)})
    got = me.spearman(spark.createDataFrame(pdf)).first()["spearman"]
    assert got == pytest.approx(pdf.y.rank().corr(pdf.p.rank()))
    one = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert me.spearman(one).first()["spearman"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=0, max_size=20))
def test_r2_of_any_rows(spark, rows):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "y double, p double")
    got = df.agg(sc.r2("y", "p").alias("x")).first()["x"]
    y, p = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    tot = ((y - y.mean()) ** 2).sum() if len(y) else 0
    if tot > 1e-3:
        assert got == pytest.approx(1 - ((y - p) ** 2).sum() / tot, rel=1e-6, abs=1e-6)


def atoms(spark):
    rows = [("b", 0, "Er", 0.0, 0.0, 0.0, 2.0), ("b", 1, "O", 2.0, 0.0, 0.0, -0.5), ("b", 2, "O", 0.0, 2.0, 0.0, -0.5), ("b", 3, "N", 0.0, 0.0, 3.5, -1.0)]
    return spark.createDataFrame(rows, "build_id string, i long, symbol string, x double, y double, z double, charge double")


def test_geometry_closed_forms(spark):
    a = atoms(spark)
    around = ge.to_centre(a, F.col("symbol") == "Er")
    assert ge.coordination(around).first()["donors"] == "O,O"
    assert sorted(round(r["angle"], 6) for r in ge.angles(around).collect()) == [90, 90, 90]
    assert ge.integral_charge(a).first()["integral"]
    c, s = np.cos(0.7), np.sin(0.7)
    turned = a.select("build_id", "i", "symbol", (c * F.col("x") - s * F.col("y") + 3).alias("x"), (s * F.col("x") + c * F.col("y")).alias("y"), (F.col("z") - 1).alias("z"), "charge")
    assert ge.kabsch(a, turned).first()["rmsd"] == pytest.approx(0, abs=1e-6)
    mirrored = a.withColumn("x", -F.col("x")).withColumn("y", F.col("y") * 1.5)
    assert ge.kabsch(a, mirrored).first()["rmsd"] > 0.1
    assert all(abs(sum(x * x for x in u) - 1) < 1e-9 for u in ge.directions(64))
    r = ge.rank_one(a, turned, a.select("build_id", "i", *((F.col(k)).alias(k) for k in "xyz"))).first()
    assert r["factor"] == pytest.approx(0)


def test_radius_join_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"build_id": np.repeat([1, 2], 60), "i": np.arange(120), **{c: rng.normal(size=120) * 3 for c in "xyz"}})
    got = {(r["i"], r["j"]) for r in re_.radius_join(spark.createDataFrame(pdf), 1.5).collect()}
    p = pdf[["x", "y", "z"]].to_numpy()
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if pdf.build_id[i] == pdf.build_id[j] and np.linalg.norm(p[i] - p[j]) <= 1.5}
    assert got == want


def test_triangle_boundaries_close(spark):
    e = spark.createDataFrame([("b", 1, 2), ("b", 2, 3), ("b", 1, 3), ("b", 3, 4)], "build_id string, i int, j int")
    tri = ge.triangles(e)
    assert [tuple(r)[1:] for r in tri.collect()] == [(1, 2, 3)]
    assert all(r["n"] == 2 for r in ge.boundary_degrees(tri).collect())


def test_schema_reconciliation(spark):
    alias = spark.createDataFrame([("b", "OK", "p.xyz")], "build_id string, qc_class string, accepted_xyz_path string")
    df, done = ge.reconcile(alias)
    assert "xyz_path" in df.columns and df.first()["xyz_exists"] and len(done) == 2
    both = alias.withColumn("xyz_path", F.lit("kept"))
    df, done = ge.reconcile(both)
    assert df.first()["xyz_path"] == "kept" and "accepted_xyz_path" in df.columns
    df, done = ge.reconcile(alias.drop("accepted_xyz_path"))
    assert not df.first()["xyz_exists"] and done == ["xyz_exists false"]
    rescued = spark.createDataFrame([("b", "OK", True), ("c", "BAD", True)], "build_id string, qc_class string, xyz_exists boolean")
    first = spark.createDataFrame([("b", "OK", False), ("c", "BAD", False)], "build_id string, qc_class string, xyz_exists boolean")
    got = {r["build_id"]: r["xyz_exists"] for r in ge.merged_index([first, rescued]).collect()}
    assert got == {"b": True, "c": False}
    assert ge.gate_drift(first).first()["drift"]


def test_documents_only_grow():
    assert xr.only_appended("a\nb", "a\nx\nb\nc") and not xr.only_appended("a\nb", "b\na")


def test_constant_confounders_and_empty_frames_are_null(spark):
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert flat.agg(sc.corr("a", "b").alias("x")).first()["x"] is None
    none = spark.createDataFrame([], "y double, p double")
    assert none.agg(sc.r2("y", "p").alias("x")).first()["x"] is None and me.errors(none).first()["n"] == 0


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3]], "v double")
    got = {(r["v"], r["bin"]) for r in me.quantile_bins(df, "v", 3).collect()}
    assert len({b for v, b in got if v == 1}) == 1


def dealt_plainly(counts, ruled):
    rule, state = ruled
    out = {}
    for name, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        out[name], state = rule(state, n)
    return out


@pytest.mark.parametrize("name", ["lightest", "alternating", "draft"])
def test_dealing_by_sizes_is_dealing_one_by_one(spark, name):
    """Long runs of equal sizes, a giant, sizes that fall by leaps, groups of size 0."""
    ruled = {"lightest": rs.lightest(5), "alternating": rs.alternating(), "draft": rs.draft()}[name]
    rng = np.random.default_rng(8)
    sizes = [*rng.integers(0, 12, 500).tolist(), *[1] * 700, *[7] * 300, 900, 250, *rng.integers(0, 300, 40).tolist()]
    counts = [(f"g{k:04d}", int(n)) for k, n in enumerate(rng.permutation(sizes))]
    got = {r["grp"]: r["part"] for r in rs.dealt(spark.createDataFrame(counts, "grp string, n long").repartition(7), "n", ruled).collect()}
    assert got == dealt_plainly(counts, ruled)


def test_rules_against_their_plain_forms():
    rng = np.random.default_rng(1)
    counts = [(f"g{k:03d}", int(n)) for k, n in enumerate(rng.integers(0, 30, 200))]
    assert dealt_plainly(counts, rs.lightest(5)) == rs.balanced_folds(counts, 5)
    sides = rs.even_split(counts)
    assert dealt_plainly(counts, rs.alternating()) == {g: k for k, own in enumerate(sides) for g in own}
    load, zero, slots = [0, 0, 0], 0, [0, 0, 1, 2, 2, 1, 0, 0]
    for k, (g, n) in enumerate(sorted(counts, key=lambda x: (-x[1], x[0]))):
        part = dealt_plainly(counts, rs.draft())[g] if k % 20 == 0 or not n else None
        want = zero % 3 if not n else slots[k % 8] if load[slots[k % 8]] <= min(load) + n else load.index(min(load))
        assert part is None or part == want
        load[want] += n
        zero += not n


def test_a_pattern_of_any_length_is_short():
    first, cycle, state = rs.pattern(rs.draft()[0], ((40, 3, 0), 5, 1), 7, 10**9)
    assert len(first) + len(cycle) < 200
    rule, one = rs.draft()[0], ((40, 3, 0), 5, 1)
    for k in range(500):
        part, one = rule(one, 7)
        assert part == (first[k] if k < len(first) else cycle[(k - len(first)) % len(cycle)])
