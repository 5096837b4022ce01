"""Item scores of many keys at once against least squares of each."""

import numpy as np
import pandas as pd
import pytest

from grainmill.operators import predict as pr


def test_many_keys_and_one_that_spans_batches(spark):
    rng = np.random.default_rng(6)
    rows = [(f"k{k}" if k else None, k % 5, int(x), int(y), float(rng.normal())) for k in range(400) for x, y in (rng.choice(6, 2, replace=False) for _ in range(rng.integers(1, 9)))]
    rows += [("wide", 0, int(x), int(y), float(rng.normal())) for x, y in (rng.choice(40, 2, replace=False) for _ in range(900))]
    df = spark.createDataFrame(rows, "k string, m int, a int, b int, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {(r["k"], r["m"], r["item"]): r["score"] for r in pr.transitive_scores(df, ["k", "m"], "a", "b", "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key, g in pd.DataFrame(rows, columns=list("kmabv")).groupby(["k", "m"], dropna=False):
        items = sorted(set(g.a) | set(g.b))
        design = np.zeros((len(g), len(items)))
        for n, (x, y) in enumerate(zip(g.a, g.b, strict=True)):
            design[n, items.index(x)], design[n, items.index(y)] = 1, -1
        name = None if pd.isna(key[0]) else key[0]
        want |= {(name, int(key[1]), int(x)): s for x, s in zip(items, np.linalg.lstsq(design, g.v, rcond=None)[0], strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in got)


def test_small_keys_share_a_task(spark):
    """No group of the plan is one key: every key took a call of its own before."""
    df = spark.createDataFrame([(1, 1, 2, 1.0)], "k int, a int, b int, v double")
    plan = pr.transitive_scores(df, ["k"], "a", "b", "v")._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroups" not in plan
