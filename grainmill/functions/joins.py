"""Group statistics beside each row, without gathering a hot group in one task as a window would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shuffle that one task should get.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about so many rows, dealt by keys into as many partitions as they need; df itself where the session's own number of partitions is enough."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


#: A hot group has more than this share of all rows, so there are at most as many of them.
HOT_GROUPS = 1000


def with_group(rows: DataFrame, key: str, stats: dict[str, Column]) -> DataFrame:
    """rows with aggregates of their key's rows as further columns; null is a key.

    Sums are partial before the shuffle. Hot groups' results (HOT_GROUPS rows at most) are broadcast; the others' are joined by a
    shuffle, in which the hot rows are spread."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    by = rows.groupBy(name.alias("_k")).agg(F.count("*").alias("_n"), *(c.alias(f"_s_{k}") for k, c in stats.items()))
    by = by.crossJoin(F.broadcast(by.agg(F.sum("_n").alias("_t"))))
    hot = by.filter(F.col("_n") * HOT_GROUPS > F.col("_t")).select(F.col("_k").alias("_hk"), *(F.col(f"_s_{k}").alias(f"_h_{k}") for k in stats))
    cold = by.filter(F.col("_n") * HOT_GROUPS <= F.col("_t")).select(F.col("_k").alias("_ck"), *(F.col(f"_s_{k}").alias(f"_c_{k}") for k in stats))
    out = rows.withColumn("_rk", name).join(F.broadcast(hot), F.col("_rk") == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col("_rk")).otherwise(F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    return out.select(*(F.col(c) for c in rows.columns), *(F.when(F.col("_hk").isNotNull(), F.col(f"_h_{k}")).otherwise(F.col(f"_c_{k}")).alias(k) for k in stats))
