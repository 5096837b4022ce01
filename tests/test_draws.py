"""Sums over drawn groups against draws made one by one."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import hashes
from grainmill.operators import resampling as rs


def literal(text):
    return int(hashlib.md5(text).hexdigest()[:8], 16)


@pytest.mark.parametrize("length", [0, 1, 3, 4, 31, 54, 55, 56, 70])
def test_hashes_of_rows(length):
    rows = np.random.default_rng(length).integers(0, 256, (40, length)).astype(np.uint8)
    assert hashes.hash32_rows(rows).tolist() == [literal(r.tobytes()) for r in rows]


@pytest.mark.parametrize("head", [b"", b"17|3|", b"17|4321|", b"x" * 53, b"x" * 60])
@pytest.mark.parametrize("width", [0, 1, 3, 7])
def test_hashes_of_one_head_and_many_tails(monkeypatch, head, width):
    """F3 of r04: the same hashes, more than one pass of them, without a message being built."""
    monkeypatch.setattr(hashes, "_TAILS", 16)
    rows = np.random.default_rng(width).integers(0, 256, (40, width)).astype(np.uint8)
    assert hashes.Tails(rows).hash32(head).tolist() == [literal(head + r.tobytes()) for r in rows]


def test_draws_are_added_where_they_are_hashed(spark, monkeypatch):
    """F3 of r04: values of few groups at a time, draws in bands; what is shuffled are blocks of groups, and no slot or count."""
    monkeypatch.setattr(rs, "BLOCK", 8)
    monkeypatch.setattr(rs, "HELD", 2 * 8 * 8 * 2)
    monkeypatch.setattr(rs, "SLOTS_AT_ONCE", 30)
    n, values = 101, [float(k * k % 17) for k in range(100)] + [0.0]
    by = spark.createDataFrame([(f"g{k:03}" if k < 100 else None, values[k]) for k in range(n)], "grp string, v double").repartition(3)
    picks = [[literal(f"s|{draw}|{slot}".encode()) % n for slot in range(n)] for draw in range(37)]
    for collapse in (False, True):
        drawn = rs.drawn_sums(by, ["v"], 37, "s", collapse=collapse)
        want = {d: (sum(k < 100 for k in p), sum(values[k] for k in p)) for d, p in enumerate([sorted(set(p)) if collapse else p for p in picks])}
        assert {r["draw"]: (r["times"], r["v"]) for r in drawn.collect()} == want
        assert "_counts" not in drawn._jdf.queryExecution().toString()


def test_digits():
    numbers = np.array([0, 9, 10, 99, 100, 123456789])
    got = {int(numbers[k]): bytes(row).decode() for at, rows in hashes.digits(numbers) for k, row in zip(at, rows, strict=True)}
    assert got == {int(x): str(x) for x in numbers}


def test_draws_number_many_groups_by_name(spark):
    """More groups than one block, and than the old numbering took in one piece."""
    n = 100_500
    by = spark.range(n).select(F.concat(F.lit("g"), "id").alias("grp"), (F.col("id") % 7).alias("v"))
    got = {r["draw"]: (r["times"], r["v"]) for r in rs.drawn_sums(by, ["v"], 2, "s").collect()}
    order = sorted(range(n), key=lambda k: f"g{k}")
    for draw in (0, 1):
        picks = [literal(f"s|{draw}|{slot}".encode()) % n for slot in range(n)]
        assert got[draw] == (n, sum(order[k] % 7 for k in picks))


def test_sums_are_those_of_draws(spark):
    values = {"a": 1.0, "b": None, "c": float("inf"), "d": -2.5, "e": 4.0, None: 9.0}
    by = spark.createDataFrame(list(values.items()), "grp string, v double")
    for collapse in (False, True):
        drawn = rs.draws(by, 30, "x", collapse=collapse).collect()
        want = {}
        for r in drawn:
            times, v = want.get(r["draw"], (0, 0.0))
            want[r["draw"]] = times + r["times"], v + r["times"] * (values[r["grp"]] or 0)
        got = {r["draw"]: (r["times"], r["v"]) for r in rs.drawn_sums(by, ["v"], 30, "x", collapse=collapse).collect()}
        assert got == want
    assert rs.drawn_sums(by.limit(0), ["v"], 3, "x").count() == 0


def stratified_plainly(sizes, k):
    strata = sorted({s for _, s, _ in sizes})
    by = {}
    for g, s, n in sizes:
        by.setdefault(g, np.zeros(len(strata)))[strata.index(s)] += n
    total, load, out = np.maximum(sum(by.values()), 1), np.zeros((k, len(strata))), {}
    for g in sorted(by, key=lambda g: (-by[g].std(), -by[g].sum(), g)):
        score = []
        for f in range(k):
            trial = load.copy()
            trial[f] += by[g]
            score.append(((trial / total).std(0).mean(), load[f].sum(), f))
        f = min(score)[2]
        out[g] = f
        load[f] += by[g]
    return out


def test_stratified_folds_are_the_plain_ones_in_less_time(spark):
    rng = np.random.default_rng(5)
    for strata, k in ((1, 2), (3, 5), (9, 4)):
        sizes = [(f"g{g}", f"s{s}", int(rng.integers(0, 9))) for g in range(60) for s in range(strata)]
        assert rs.stratified_folds(sizes, k) == stratified_plainly(sizes, k)
        got = rs.stratified_fold_table(spark.createDataFrame(sizes, "grp string, stratum string, n long"), k).collect()
        assert {r["grp"]: r["fold"] for r in got} == stratified_plainly(sizes, k)
    odd = spark.createDataFrame([("a", "x", 3), ("a", None, 1), (None, "x", 3), ("b", None, 2)], "grp string, stratum string, n long")
    assert {r["grp"] for r in rs.stratified_fold_table(odd, 2).collect()} == {"a", "b", None}
    sizes = [(f"g{g}", s, int(rng.integers(0, 60))) for g in range(6000) for s in "ANR"]
    began = time.process_time()
    new = rs.stratified_folds(sizes, 5)
    middle = time.process_time()
    assert new == stratified_plainly(sizes, 5)
    assert 2 * (middle - began) < time.process_time() - middle


def test_sides_of_hashed_groups(spark):
    """Names of several lengths, some too long for one block of MD5, and more draws than one pass takes."""
    names = ["a", "bb", "é", "x" * 60, *(f"g{k}" for k in range(700))]
    by = spark.createDataFrame([(n, float(k)) for k, n in enumerate(names)], "grp string, v double").repartition(3)
    got = {r["draw"]: r["v"] for r in rs.hashed_sums(by, ["v"], 120, "9", 1000, 200).filter("inside").collect()}
    want = {d: sum(k for k, n in enumerate(names) if literal(f"9|{d}|{n}".encode()) % 1000 < 200) for d in range(120)}
    assert got == want
