"""Scores of predictions, over rows, groups, blocks and pairs. A score of a constant target is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import with_group
from ..functions.ranks import quantiles, value_ranks
from ..functions.scalars import average_rank, corr, is_true, mae, median, r2, ratio, rmse, sign_accuracy, sse, sst


def centred(df: DataFrame, key: str, columns: list[str], suffix: str = "_c") -> DataFrame:
    """Each column less its mean by key, beside the column."""
    out = with_group(df, key, {f"_mean_{c}": F.avg(c) for c in columns})
    return out.withColumns({f"{c}{suffix}": F.col(c) - F.col(f"_mean_{c}") for c in columns}).drop(*(f"_mean_{c}" for c in columns))


def weighted_r2(df: DataFrame, weight: str) -> DataFrame:
    """1 - sum w (y - p)^2 / sum w (y - weighted mean)^2, in two passes."""
    mean = df.agg((F.sum(F.col(weight) * F.col("y")) / F.sum(weight)).alias("m"))
    return df.crossJoin(F.broadcast(mean)).agg((1 - ratio(F.sum(F.col(weight) * (F.col("y") - F.col("p")) ** 2), F.sum(F.col(weight) * (F.col("y") - F.col("m")) ** 2))).alias("r2"))


def decomposed_r2(df: DataFrame, group: str = "grp") -> DataFrame:
    """R2 overall, between groups (by size and not) and within, and the within share of the variance."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("p").alias("mp"), sst("y").alias("wy"), F.sum((F.col("y") - F.col("p")) ** 2).alias("e"))
    # within a group: sum ((y - my) - (p - mp))^2 = sum (y - p)^2 - n (my - mp)^2
    by = by.withColumn("we", F.col("e") - F.col("n") * (F.col("my") - F.col("mp")) ** 2)
    total = by.agg((F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("m"))
    return by.crossJoin(F.broadcast(total)).agg(
        (1 - ratio(F.sum("e"), F.sum(F.col("wy") + F.col("n") * (F.col("my") - F.col("m")) ** 2))).alias("r2"),
        (1 - ratio(F.sum(F.col("n") * (F.col("my") - F.col("mp")) ** 2), F.sum(F.col("n") * (F.col("my") - F.col("m")) ** 2))).alias("r2_between_weighted"),
        r2("my", "mp").alias("r2_between"),
        (1 - ratio(F.sum("we"), F.sum("wy"))).alias("r2_within"),
        ratio(F.sum("wy"), F.sum(F.col("wy") + F.col("n") * (F.col("my") - F.col("m")) ** 2)).alias("within_share"),
    )


def group_r2(df: DataFrame, group: str = "grp", least: int = 10) -> DataFrame:
    """R2 of each group of at least `least` rows."""
    return df.groupBy(group).agg(F.count("*").alias("n"), r2("y", "p").alias("r2")).filter((F.col("n") >= least) & F.col("r2").isNotNull())


def group_r2_summary(df: DataFrame, group: str = "grp", least: int = 10) -> DataFrame:
    """Weighted mean, median and share above 0 of the groups' R2: means alone mislead where a denominator is near 0."""
    return group_r2(df, group, least).agg(F.count("*").alias("groups"), (F.sum(F.col("n") * F.col("r2")) / F.sum("n")).alias("mean_r2"), median("r2").alias("median_r2"), F.avg(is_true(F.col("r2") > 0)).alias("share_positive"))


def block_r2(df: DataFrame, block: str = "blk") -> DataFrame:
    """R2 after taking each block's means out of y and p."""
    by = df.groupBy(block).agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("p").alias("mp"), sst("y").alias("wy"), F.sum((F.col("y") - F.col("p")) ** 2).alias("e"))
    return by.agg((1 - ratio(F.sum(F.col("e") - F.col("n") * (F.col("my") - F.col("mp")) ** 2), F.sum("wy"))).alias("r2_block"))


def errors(df: DataFrame) -> DataFrame:
    middle = quantiles(df, F.abs(F.col("y") - F.col("p")), [0.5]).withColumnRenamed("q0", "median_ae")
    return df.agg(F.count("*").alias("n"), rmse("y", "p").alias("rmse"), mae("y", "p").alias("mae")).crossJoin(F.broadcast(middle))


def pearson(df: DataFrame, group: str = "grp") -> DataFrame:
    """Pooled, and within groups."""
    return centred(df, group, ["y", "p"]).agg(corr("y", "p").alias("pearson"), corr("y_c", "p_c").alias("pearson_within"))


def spearman_of(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation by key with ties averaged; spearman() is that of all rows."""
    ranks = df.select(*by, average_rank(a, by).alias("_a"), average_rank(b, by).alias("_b"))
    return ranks.groupBy(*by).agg(corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def spearman(df: DataFrame, a: str = "y", b: str = "p") -> DataFrame:
    """Overall rank correlation with ties averaged. Rows become counts of distinct value pairs before anything is joined, and ranks come from bins of values."""
    pairs = df.groupBy(a, b).agg(F.count("*").alias("_c"))

    def ranked(x: str, name: str) -> DataFrame:
        return value_ranks(pairs.groupBy(x).agg(F.sum("_c").alias("_n")), x, "_n", name).select(x, name)

    out = pairs.join(ranked(a, "_ra"), a).join(ranked(b, "_rb"), b)
    n = F.sum("_c")
    # Ranks have the mean (n + 1) / 2; sums about a row's half of n keep their digits.
    x, y = (F.col(r) - F.lit(1.0) for r in ("_ra", "_rb"))
    s = lambda c: F.sum(F.col("_c") * c)
    cov, vx, vy = n * s(x * y) - s(x) * s(y), n * s(x * x) - s(x) ** 2, n * s(y * y) - s(y) ** 2
    return out.agg(ratio(cov, F.sqrt(vx) * F.sqrt(vy)).alias("spearman"))


def block_kendall(cells: DataFrame, block: str = "blk") -> DataFrame:
    """Mean over blocks of Kendall's tau-b of y and p."""
    from .cells import all_pairs

    d = all_pairs(cells, ["y", "p"], block)
    s = F.signum("d_y") * F.signum("d_p")
    by = d.groupBy(block).agg(F.sum(s).alias("s"), F.sum(is_true(F.col("d_y") != 0)).alias("ny"), F.sum(is_true(F.col("d_p") != 0)).alias("np"))
    return by.withColumn("tau", ratio("s", F.sqrt(F.col("ny") * F.col("np")))).agg(F.count("tau").alias("blocks"), F.avg("tau").alias("mean_tau"))


def series_order(cells: DataFrame, block: str = "blk", least: int = 3) -> DataFrame:
    """Mean and median over blocks of at least `least` cells of the rank correlation of y and p."""
    return spearman_of(cells, "y", "p", [block]).filter((F.col("n") >= least) & F.col("rho").isNotNull()).agg(F.count("*").alias("blocks"), F.avg("rho").alias("mean_rho"), median("rho").alias("median_rho"))


def separation(pairs: DataFrame, block: str = "blk") -> DataFrame:
    """Scores over all pairs of blocks: d_y against d_p."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_distinct(block).alias("blocks"), mae("d_y", "d_p").alias("mae"), r2("d_y", "d_p").alias("r2"), sign_accuracy("d_y", "d_p").alias("sign_accuracy"))


def pair_metrics(pairs: DataFrame, y: str = "dy", p: str = "dp", by: list[str] | None = None) -> DataFrame:
    """n, R2, MAE, sign accuracy, SD of the truth (population) and Pearson of pair differences."""
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), r2(y, p).alias("r2"), mae(y, p).alias("mae"), sign_accuracy(y, p).alias("sign_accuracy"), F.stddev_pop(y).alias("true_sd"), corr(y, p).alias("pearson"))


def index_r2(df: DataFrame, least: int = 10) -> DataFrame:
    """Mean and least R2 over indices."""
    by = df.groupBy("idx").agg(F.count("*").alias("n"), r2("y", "p").alias("r2")).filter(F.col("n") >= least)
    return by.agg(F.count("*").alias("indices"), F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_r2"))


def pooled_sd(df: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """sqrt of the mean of sample variances, weighted by degrees of freedom."""
    by = df.groupBy(*keys).agg(F.count(value).alias("n"), sst(value).alias("ss")).filter("n > 1")
    return by.agg(F.count("*").alias("cells"), F.sqrt(ratio(F.sum("ss"), F.sum(F.col("n") - 1))).alias("pooled_sd"))


def error_split(df: DataFrame, group: str = "grp") -> DataFrame:
    """Each group's offset (n bias^2) and scatter, and its share of the whole squared error."""
    by = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("p")).alias("bias"), sse("y", "p").alias("sse"))
    whole = by.agg(F.sum("sse").alias("whole"))
    return by.crossJoin(F.broadcast(whole)).select(group, "n", "bias", (F.col("n") * F.col("bias") ** 2).alias("offset"), (F.col("sse") - F.col("n") * F.col("bias") ** 2).alias("scatter"), ratio("sse", "whole").alias("share"))


def solved_r2(pairs: DataFrame, group: str = "grp", y: str = "dy", p: str = "dp") -> DataFrame:
    """Each group's share of the pair error, and R2 over all pairs if that group had none."""
    by = pairs.groupBy(group).agg(F.count("*").alias("n"), sse(y, p).alias("sse"))
    whole = pairs.agg(sse(y, p).alias("whole"), sst(y).alias("total"))
    return by.crossJoin(F.broadcast(whole)).select(group, "n", "sse", ratio("sse", "whole").alias("share"), (1 - ratio(F.col("whole") - F.col("sse"), "total")).alias("r2_if_solved"))


def macro_mae(df: DataFrame, group: str = "grp") -> DataFrame:
    return df.groupBy(group).agg(mae("y", "p").alias("m")).agg(F.avg("m").alias("macro_mae"))


def seed_metrics(pairs: DataFrame, group: str = "grp") -> DataFrame:
    """Scores of all pairs of one run: macro and pooled MAE, R2, signs, dispersion, and MAE of neighbours and others."""
    by = pairs.groupBy(group).agg(mae("d_y", "d_p").alias("m")).agg(F.avg("m").alias("macro_mae"))
    near = F.col("gap") == 1
    d = F.abs(F.col("d_y") - F.col("d_p"))
    return pairs.agg(mae("d_y", "d_p").alias("mae"), r2("d_y", "d_p").alias("r2"), sign_accuracy("d_y", "d_p").alias("sign_accuracy"), ratio(F.stddev_pop("d_p"), F.stddev_pop("d_y")).alias("dispersion"), F.avg(F.when(near, d)).alias("mae_adjacent"), F.avg(F.when(~near, d)).alias("mae_other")).crossJoin(F.broadcast(by))


def quantile_bins(df: DataFrame, by: str, bins: int) -> DataFrame:
    """df with bin 0 .. bins - 1 by quantile edges of a column: values equal to an edge share a bin, so bins of tied data differ in size."""
    edges = quantiles(df, by, [k / bins for k in range(1, bins)]).select(F.array(*(f"q{k}" for k in range(bins - 1))).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col(by)))).drop("_edges")


def weighted_corr(df: DataFrame, a: str, b: str, w: str) -> DataFrame:
    m = df.agg((F.sum(F.col(w) * F.col(a)) / F.sum(w)).alias("_ma"), (F.sum(F.col(w) * F.col(b)) / F.sum(w)).alias("_mb"))
    x, y = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    return df.crossJoin(F.broadcast(m)).agg(ratio(F.sum(F.col(w) * x * y), F.sqrt(F.sum(F.col(w) * x * x) * F.sum(F.col(w) * y * y))).alias("corr"))


def full_metrics(df: DataFrame, cells: DataFrame, adjacent_pairs: DataFrame, all_pairs: DataFrame) -> DataFrame:
    """One wide row of all scores."""
    parts = [
        errors(df),
        decomposed_r2(df),
        group_r2_summary(df),
        block_r2(df),
        pearson(df),
        index_r2(df).withColumnsRenamed({"mean_r2": "index_mean_r2", "min_r2": "index_min_r2"}),
        series_order(cells).withColumnRenamed("blocks", "series_blocks"),
        pair_metrics(adjacent_pairs).withColumnsRenamed({c: f"adjacent_{c}" for c in ("n", "r2", "mae", "sign_accuracy", "true_sd", "pearson")}),
        separation(all_pairs).withColumnsRenamed({c: f"separation_{c}" for c in ("pairs", "blocks", "mae", "r2", "sign_accuracy")}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # each is one row
    return out
