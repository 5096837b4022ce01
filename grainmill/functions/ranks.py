"""Ranks and quantiles of whole tables without a task that sees all rows.

Rows or distinct values are binned in order: hashes by their leading bits, values by EDGES approximate quantiles (any edges give the right
ranks, good ones give even bins). What lies before a bin is a sum over at most EDGES + 1 or 4096 bins; inside a bin a window ranks its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = 127


def numbered(df: DataFrame, h: Column, *ties: str, name: str = "_k") -> DataFrame:
    """df with each row's place, from 0, in the order of a 32-bit hash and then of ties."""
    binned = df.withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 20))
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("_s"))
    before = sizes.select("_bin", (F.sum("_s").over(Window.orderBy("_bin")) - F.col("_s")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy("_h", *ties)) - 1
    return binned.join(F.broadcast(before), "_bin").withColumn(name, F.col("_before") + inside).drop("_h", "_bin", "_before")


def _binned(values: DataFrame, x: str) -> DataFrame:
    edges = values.agg(F.percentile_approx(x, F.array(*(F.lit((k + 1) / (EDGES + 1)) for k in range(EDGES))), F.lit(2000)).alias("_edges"))
    return values.crossJoin(F.broadcast(edges)).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(x)))).drop("_edges")


def _before(binned: DataFrame, n: str) -> DataFrame:
    sums = binned.groupBy("_bin").agg(F.sum(n).alias("_s"))
    return sums.select("_bin", "_s", (F.sum("_s").over(Window.orderBy("_bin")) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_all"))


def value_ranks(counts: DataFrame, x: str, n: str, name: str = "rank") -> DataFrame:
    """counts, which has one row a value x and its number of rows n, with the average rank of these rows among all."""
    binned = _binned(counts, x)
    inside = F.sum(n).over(Window.partitionBy("_bin").orderBy(x)) - F.col(n)
    return binned.join(F.broadcast(_before(binned, n)), "_bin").withColumn(name, F.col("_before") + inside + (F.col(n) + 1) / 2).drop("_bin", "_s", "_before", "_all")


def placed(df: DataFrame, x: str, *ties: str, name: str = "_r") -> DataFrame:
    """df with each row's place, from 0, in the order of a number x and then of ties; _all has the number of rows."""
    binned = _binned(df, x).withColumn("_one", F.lit(1))
    inside = F.row_number().over(Window.partitionBy("_bin").orderBy(x, *ties)) - 1
    return binned.join(F.broadcast(_before(binned, "_one")), "_bin").withColumn(name, F.col("_before") + inside).drop("_bin", "_s", "_before", "_one")


def quantiles(df: DataFrame, x: Column | str, levels: list[float]) -> DataFrame:
    """One row q0, q1, ...: exact quantiles of x by linear interpolation, nulls left out; null where there is no value.

    Values are counted, and only the bins that hold a wanted place are looked at value by value."""
    counts = df.select((F.col(x) if isinstance(x, str) else x).cast("double").alias("_x")).filter("_x is not null").groupBy("_x").agg(F.count("*").alias("_n"))
    binned = _binned(counts, "_x")
    at = [F.lit(q) * (F.col("_all") - 1) for q in levels]
    places = F.array(*(F.struct(F.lit(2 * k + side).alias("k"), f(p).cast("long").alias("place")) for k, p in enumerate(at) for side, f in enumerate((F.floor, F.ceil))))
    want = _before(binned, "_n").withColumn("_w", F.explode(places)).filter("_w.place >= _before and _w.place < _before + _s")
    inside = binned.join(F.broadcast(want), "_bin").withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy("_w.k").orderBy("_x")))
    hit = inside.filter("_w.place < _to and _w.place >= _to - _n")
    one = hit.agg(F.max("_all").alias("_all"), *(F.max(F.when(F.col("_w.k") == k, F.col("_x"))).alias(f"_{k}") for k in range(2 * len(levels))))
    return one.select(*((F.col(f"_{2 * k}") + (F.col(f"_{2 * k + 1}") - F.col(f"_{2 * k}")) * (p - F.floor(p))).alias(f"q{k}") for k, p in enumerate(at)))
