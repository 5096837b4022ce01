"""Digests of groups in order against hashlib on the whole text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from grainmill.functions.digests import ordered_digest


@pytest.mark.parametrize("batch", [7, 10000])
def test_digest_of_groups_larger_than_a_batch(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        data = [(None if k % 11 == 0 else "hot" if k % 3 else f"g{k % 50}", k % 2, (k * 7919) % 3001, f"é{k}") for k in range(3000)]
        df = spark.createDataFrame(data, "g string, s long, o long, x string").repartition(9)
        got = {(r["g"], r["s"]): (r["n"], r["digest"]) for r in ordered_digest(df, ["g", "s"], ["o"], F.col("x"), ", ").collect()}
        want = {}
        for g, s, o, x in sorted(data, key=lambda r: r[2]):
            want.setdefault((g, s), []).append(x)
        assert got == {k: (len(v), hashlib.sha256(", ".join(v).encode()).hexdigest()) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(spark):
    assert ordered_digest(spark.createDataFrame([], "g long, x string"), ["g"], ["x"], F.col("x"), ",").count() == 0
