"""Scalar and aggregate expressions that the operators share. Undefined ratios are null, never an error."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, null where b is 0."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def r6(x: ColumnLike) -> Column:
    """Six decimals: double sums differ in their last bits with the partitioning."""
    return F.round(col(x), 6)


def hash32(x: ColumnLike) -> Column:
    """The first 32 bits of the MD5, as a bigint: the same number in any engine."""
    return F.conv(F.substring(F.md5(col(x).cast("string")), 1, 8), 16, 10).cast("bigint")


def clip(x: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def finite(x: ColumnLike) -> Column:
    return col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf")))


def is_true(c: Column) -> Column:
    """1.0 or 0.0, for shares."""
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank with ties averaged."""
    by = by or []
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def sse(y: ColumnLike, p: ColumnLike) -> Column:
    return F.sum((col(y) - col(p)) * (col(y) - col(p)))


def sst(y: ColumnLike) -> Column:
    """Sum of squares about the mean, by the stable update that var_pop uses."""
    return F.var_pop(col(y)) * F.count(col(y))


def r2(y: ColumnLike, p: ColumnLike) -> Column:
    return 1 - ratio(sse(y, p), sst(y))


def corr(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson correlation, null where one side is constant."""
    return ratio(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b)))


def mae(y: ColumnLike, p: ColumnLike) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def rmse(y: ColumnLike, p: ColumnLike) -> Column:
    return F.sqrt(F.avg((col(y) - col(p)) * (col(y) - col(p))))


def median(x: ColumnLike) -> Column:
    return F.percentile(col(x), F.lit(0.5))


def sign_accuracy(y: ColumnLike, p: ColumnLike) -> Column:
    return F.avg(is_true(F.signum(col(y)) == F.signum(col(p))))


def z_of_tests(n: int, level: float = 0.05) -> float:
    """Normal quantile of a two-sided interval shared by n tests, as ppf(1 - level / n)."""
    return NormalDist().inv_cdf(1 - level / n)


def verdict(low: ColumnLike, high: ColumnLike) -> Column:
    return F.when(col(low) > 0, "adds").when(col(high) < 0, "worse").otherwise("not distinguishable")


def first_prefix(x: ColumnLike, prefixes: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first prefix that x starts with, in the order given."""
    out = None
    for prefix, name in prefixes:
        test = col(x).startswith(prefix)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def occurrences(x: ColumnLike, piece: str) -> Column:
    return ((F.length(col(x)) - F.length(F.replace(col(x), F.lit(piece), F.lit("")))) / len(piece)).cast("int")
