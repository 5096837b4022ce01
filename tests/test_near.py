"""Nearest points by halved cubes, and cross-validation that deals its folds once."""

import numpy as np
from pyspark.sql import functions as F

from grainmill.operators import ml
from grainmill.operators import relational as re_


def test_near_pairs_are_those_of_all_pairs_without_pairing_all(spark):
    """copies, a crowd, outliers, and builds with fewer points than asked for."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(2, 3)), 9, 0), 1e-4 * rng.normal(size=(60, 3)), [[50, 0, 0], [-400, 3, 1e3]]])
    rows = [(0, i, *map(float, p)) for i, p in enumerate(x)] + [(1, 500, 0.0, 0.0, 0.0), (1, 501, -0.0, 0.0, 0.0), (1, 502, 1.0, 0.0, 0.0)]
    for k in (1, 4):
        expected = set()
        for build, i, *p in rows:
            near = sorted((round(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))), 9), j) for b, j, *q in rows if b == build and j != i)[:k]
            expected |= {(build, i, j, d) for d, j in near}
        out = re_.near_pairs(spark.createDataFrame(rows, "build_id int, i long, x double, y double, z double"), k)
        assert {tuple(r) for r in out.collect()} == expected


def test_folds_are_dealt_once_and_rows_of_one_prediction_are_not_averaged(spark, monkeypatch):
    """trials share the dealt rows; ids that occur twice are still averaged."""
    dealt, own = [], ml.deal
    monkeypatch.setattr(ml, "deal", lambda *a, **k: dealt.append(own(*a, **k)) or dealt[-1])
    df = spark.range(120).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 12).cast("string").alias("grp"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    found = ml.search(df, "ridge", ["a"], trials=3, folds=3)
    assert len(dealt) == 1 and dealt[0].unique
    assert dict((p["regParam"], x) for p, x in found)[0.001] == ml.cv_score(df, "ridge", ["a"], folds=3, regParam=0.001)
    twice = ml.grouped_cv(df.unionByName(df), "ridge", ["a"], folds=3)
    assert not dealt[-1].unique and twice.count() == 120
