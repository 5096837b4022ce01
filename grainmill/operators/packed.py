"""Rows in blocks of packed numpy arrays, standard features, and sums of arrays over all tasks: what iterative learners share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored

BLOCK_ROWS, SUMMERS = 8192, 16


def summed(parts: DataFrame, column: str) -> np.ndarray:
    """The sum of a binary column of packed doubles, all of one length: added up in SUMMERS tasks a row at a time, whose sums come to the driver."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for part in batch.column(0):
                one = np.frombuffer(part.as_buffer(), "f8")
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    rows = parts.select(column).repartition(SUMMERS).mapInArrow(run, "s binary").toArrow()["s"].to_pylist()
    return sum(np.frombuffer(r, "f8") for r in rows) if rows else np.zeros(0)


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """df with x: the features as an array, missing values as the median, less the mean and by the standard deviation (1 where that is 0)."""
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    middle = df.agg(*(F.percentile_approx(v, 0.5, F.lit(10_000)).alias(c) for c, v in number.items())).first()
    filled = {c: F.coalesce(v, F.lit(float(middle[c] or 0.0))) for c, v in number.items()}
    row = df.agg(*(F.avg(v).alias(f"m_{c}") for c, v in filled.items()), *(F.stddev_pop(v).alias(f"s_{c}") for c, v in filled.items())).first()
    return df.withColumn("x", F.array(*((v - F.lit(float(row[f"m_{c}"] or 0.0))) / F.lit(float(row[f"s_{c}"] or 1.0) or 1.0) for c, v in filled.items())))


def packed(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """ids, grp, x, y, fold and extra (doubles) of blocks of at most BLOCK_ROWS rows, stored; from row_id, grp, x (arrays of one length), y, fold."""
    numbers = ["y", "fold", *extra]
    slim = df.select(F.col("row_id").cast("string").alias("row_id"), F.col("grp").cast("string").alias("grp"), "x", *(F.col(c).cast("double").alias(c) for c in numbers))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                lists = [pa.array([batch.column(c)], pa.list_(pa.string())) for c in ("row_id", "grp")]
                x = np.asarray(batch.column("x").values.to_numpy(zero_copy_only=False), "f8")
                rest = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False), "f8") for c in numbers]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([a.tobytes()]) for a in (x, *rest))], names=["ids", "grp", "x", *numbers])

    conf = df.sparkSession.conf
    held = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCK_ROWS)
    try:
        return stored(slim.mapInArrow(run, "ids array<string>, grp array<string>, x binary, " + ", ".join(f"{c} binary" for c in numbers)))
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def array(row, name: str) -> np.ndarray:
    return np.frombuffer(row[name].as_buffer(), "f8")


def predictions(blocks: DataFrame, predict) -> DataFrame:
    """row_id, y, grp, fold, oof: predict(x) gives a value a row and model, of which each row takes that of its fold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_struct_array():
                y, fold = array(row, "y"), array(row, "fold").astype(int)
                every = predict(array(row, "x").reshape(len(y), -1))
                oof = every[np.arange(len(y)), np.maximum(fold, 0)]
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(y), row["grp"].values, pa.array(fold, pa.int32()), pa.array(oof)], names=["row_id", "y", "grp", "fold", "oof"])

    return blocks.mapInArrow(run, "row_id string, y double, grp string, fold int, oof double")
