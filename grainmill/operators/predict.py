"""Predictors that follow from group sums, weights, ensembles and calibration, all nested by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import with_group
from ..functions.ranks import value_ranks
from ..functions.tails import normal_tails
from ..functions.scalars import ratio
from ..sources.files import stored


def logo_lookup(pairs: DataFrame, key: str, y: str = "dy", group: str = "grp") -> DataFrame:
    """Each pair's mean of its key over the other groups; where there is none, the mean of all other groups' pairs."""
    own = pairs.groupBy(group, key).agg(F.count("*").alias("_n"), F.sum(y).alias("_s"))
    total = own.groupBy(key).agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    side = own.groupBy(group).agg(F.sum("_n").alias("_gn"), F.sum("_s").alias("_gs"))
    whole = side.agg(F.sum("_gn").alias("_an"), F.sum("_gs").alias("_as"))
    table = own.join(F.broadcast(total), key).join(side, group).crossJoin(F.broadcast(whole))
    table = table.select(group, key, F.coalesce(ratio(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n")), ratio(F.col("_as") - F.col("_gs"), F.col("_an") - F.col("_gn"))).alias("lookup"))
    return pairs.join(table, [group, key])


def logo_pairmean(pairs: DataFrame, key: str, y: str = "dy", group: str = "grp") -> DataFrame:
    """Per group and key: the mean over the other groups of their means."""
    own = pairs.groupBy(group, key).agg(F.avg(y).alias("_m"))
    total = own.groupBy(key).agg(F.count("*").alias("_n"), F.sum("_m").alias("_s"))
    return own.join(F.broadcast(total), key).select(group, key, ratio(F.col("_s") - F.col("_m"), F.col("_n") - 1).alias("pairmean"))


def logo_slope(pairs: DataFrame, x: str, y: str = "dy", group: str = "grp") -> DataFrame:
    """Per group the slope through the origin over the other groups."""
    own = pairs.groupBy(group).agg(F.sum(F.col(x) * F.col(y)).alias("_xy"), F.sum(F.col(x) ** 2).alias("_xx"))
    whole = own.agg(F.sum("_xy").alias("_txy"), F.sum("_xx").alias("_txx"))
    return own.crossJoin(F.broadcast(whole)).select(group, ratio(F.col("_txy") - F.col("_xy"), F.col("_txx") - F.col("_xx")).alias("k"))


def logo_affine(by_group: DataFrame, arm: str, group: str = "grp", intercept: bool = True) -> DataFrame:
    """Per group the line y ~ a + b arm over the other groups, from moments; without intercept the scale alone."""
    from .resampling import less_own

    t = less_own(by_group, ["n", "s", "yy", f"s_{arm}", f"y_{arm}", f"{arm}_{arm}"])
    n, sy, sx, xx = F.col("rest_n"), F.col("rest_s") + F.col("m") * F.col("rest_n"), F.col(f"rest_s_{arm}"), F.col(f"rest_{arm}_{arm}")
    xy = F.col(f"rest_y_{arm}") + F.col("m") * sx
    if not intercept:
        return t.select(group, F.lit(0.0).alias("a"), ratio(xy, xx).alias("b"))
    b = ratio(n * xy - sx * sy, n * xx - sx * sx)
    return t.select(group, ((sy - b * sx) / n).alias("a"), b.alias("b"))


def logo_ridge(by_group: DataFrame, arms: list[str], alpha: float = 10.0, least: int = 30, group: str = "grp") -> DataFrame:
    """group, a, b0, b1, ...: the ridge fit y ~ a + b . arms over the other groups, on arms standardised by these, in closed form from moments by total less own.

    Fewer than `least` rows there give their mean. A row of the table holds all that a fit needs, so a batch of groups is solved at once."""
    import numpy as np
    import pandas as pd

    from .resampling import less_own

    t = less_own(by_group, [c for c in by_group.columns if c not in (group, "m", "yy")])
    kinds = dict(t.dtypes)

    def run(batches):
        for r in batches:
            n = np.maximum(r["rest_n"].to_numpy(float), 1)
            mean = (r["rest_s"] / n + r["m"]).to_numpy(float)
            s = np.stack([r[f"rest_s_{x}"] for x in arms], 1).astype(float)
            cov = np.empty((len(r), len(arms), len(arms)))
            for j, x in enumerate(arms):
                for k, z in enumerate(arms):
                    cov[:, j, k] = r[f"rest_{x}_{z}" if j <= k else f"rest_{z}_{x}"] - s[:, j] * s[:, k] / n
            sd = np.sqrt(np.maximum(np.einsum("njj->nj", cov), 0) / n[:, None])
            sd = np.where(sd < 1e-8, 1.0, sd)
            rhs = np.stack([r[f"rest_y_{x}"] + r["m"] * r[f"rest_s_{x}"] for x in arms], 1).astype(float) - s * mean[:, None]
            w = np.linalg.solve(cov / sd[:, :, None] / sd[:, None, :] + alpha * np.eye(len(arms)), (rhs / sd)[:, :, None])[:, :, 0] / sd
            w[r["rest_n"].to_numpy() < least] = 0
            a = mean - (w * s).sum(1) / n
            yield pd.DataFrame({group: r[group], "a": a, **{f"b{j}": w[:, j] for j in range(len(arms))}})

    return t.mapInPandas(run, f"{group} {kinds[group]}, a double, " + ", ".join(f"b{j} double" for j in range(len(arms))))


def equal_group_blend(pairs: DataFrame, base: str, encoders: list[str], weights: list[tuple[float, ...]], y: str = "dy", group: str = "grp") -> DataFrame:
    """For each group the encoder weights with the least mean over other groups of their mean squared error; the base takes the rest."""
    from .resampling import error_of_blend, less_own, grid, moments

    arms = [base, *encoders]
    full = [(1 - sum(w), *w) for w in weights]
    by = moments(pairs, y, arms, [group]).crossJoin(F.broadcast(grid(pairs.sparkSession, full)))
    mse = by.select(group, "k", *(f"w{j}" for j in range(len(arms))), ratio(error_of_blend(arms), "n").alias("mse"))
    total = mse.groupBy("k").agg(F.sum("mse").alias("_t"), F.count("*").alias("_n"))
    out = mse.join(F.broadcast(total), "k").withColumn("_rest", ratio(F.col("_t") - F.col("mse"), F.col("_n") - 1))
    return out.groupBy(group).agg(F.min_by(F.struct("k", *(f"w{j}" for j in range(1, len(arms))), "mse"), F.struct(F.round("_rest", 9), "k")).alias("b")).select(group, "b.*")


def row_weights(df: DataFrame, scheme: str, group: str = "grp", index: str = "idx") -> DataFrame:
    """weight, mean one: none, group_inv (1 / sqrt of the group's size), group_inv_full (1 / size), index_inv, combo (group_inv x index_inv)."""
    df = with_group(with_group(df, group, {"_g": F.count("*").cast("double")}), index, {"_i": F.count("*").cast("double")})
    raw = {"none": F.lit(1.0), "group_inv": 1 / F.sqrt("_g"), "group_inv_full": 1 / F.col("_g"), "index_inv": 1 / F.col("_i"), "combo": 1 / F.sqrt("_g") / F.col("_i")}
    if scheme not in raw:
        raise KeyError(f"no weight scheme {scheme!r}; there are {sorted(raw)}")
    df = df.withColumn("_w", raw[scheme]).drop("_g", "_i")
    mean = df.agg(F.avg("_w").alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("weight", ratio("_w", "_m")).drop("_w", "_m")


def density_weights(df: DataFrame, y: str, bins: int = 40, power: float = 0.6, sigma: float = 2.0) -> DataFrame:
    """Weights by a smoothed histogram of the target to a negative power, mean one."""
    import math

    spark = df.sparkSession
    bounds = df.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(y) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0))).cast("int")
    df = df.crossJoin(F.broadcast(bounds)).withColumn("_bin", at).drop("_lo", "_hi")
    reach = math.ceil(4 * sigma)
    total = sum(math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1))
    kernel = spark.createDataFrame([(d, math.exp(-d * d / (2 * sigma * sigma)) / total) for d in range(-reach, reach + 1)], "_d int, _k double")
    smooth = df.groupBy("_bin").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(kernel)).groupBy((F.col("_bin") + F.col("_d")).alias("_bin")).agg(F.sum(F.col("_n") * F.col("_k")).alias("_s"))
    df = df.join(F.broadcast(smooth), "_bin").withColumn("_w", F.pow("_s", F.lit(-power))).drop("_bin", "_s")
    mean = df.agg(F.avg("_w").alias("_m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("weight", ratio("_w", "_m")).drop("_w", "_m")


def balanced_weights(df: DataFrame, group: str = "grp") -> DataFrame:
    """n / (groups x the group's size)."""
    by = df.groupBy(group).agg(F.count("*").alias("_c"))
    whole = by.agg(F.sum("_c").alias("_n"), F.count("*").alias("_g"))
    return df.join(by, group).crossJoin(F.broadcast(whole)).withColumn("weight", F.col("_n") / (F.col("_g") * F.col("_c"))).drop("_c", "_n", "_g")


def anchored(df: DataFrame, anchor: str, shape: str, base: str, w: float, block: str = "blk") -> DataFrame:
    """anchor's block mean plus w of shape and 1 - w of base, both less their block means."""
    out = with_group(df, block, {"_a": F.avg(anchor), "_s": F.avg(shape), "_b": F.avg(base)})
    return out.withColumn("anchored", F.col("_a") + w * (F.col(shape) - F.col("_s")) + (1 - w) * (F.col(base) - F.col("_b"))).drop("_a", "_s", "_b")


def reconstruct(deltas: DataFrame, anchors: DataFrame, block: str = "blk") -> DataFrame:
    """Scores from a complete matrix of pairwise differences: row means, centred, plus the block's anchor."""
    both = deltas.select(block, F.col("i").alias("row"), "delta").unionByName(deltas.select(block, F.col("j").alias("row"), (-F.col("delta")).alias("delta")))
    n = F.count("*") + 1
    score = both.groupBy(block, "row").agg((F.sum("delta") / n).alias("_s"))
    return score.join(anchors, block).select(block, "row", (F.col("_s") - F.avg("_s").over(Window.partitionBy(block)) + F.col("anchor")).alias("score"))


def two_stage(df: DataFrame, residual: str, group: str = "grp", fold: str = "fold", y: str = "y") -> DataFrame:
    """The training folds' mean of the group plus a residual prediction; groups without training rows get the training mean."""
    own = df.groupBy(fold, group).agg(F.sum(y).alias("_s"), F.count("*").alias("_n"))
    by_group = own.groupBy(group).agg(F.sum("_s").alias("_gs"), F.sum("_n").alias("_gn"))
    by_fold = own.groupBy(fold).agg(F.sum("_s").alias("_fs"), F.sum("_n").alias("_fn"))
    whole = by_fold.agg(F.sum("_fs").alias("_as"), F.sum("_fn").alias("_an"))
    t = own.join(by_group, group).join(F.broadcast(by_fold), fold).crossJoin(F.broadcast(whole))
    t = t.select(fold, group, F.coalesce(ratio(F.col("_gs") - F.col("_s"), F.col("_gn") - F.col("_n")), ratio(F.col("_as") - F.col("_fs"), F.col("_an") - F.col("_fn"))).alias("_base"))
    return df.join(t, [fold, group]).withColumn("two_stage", F.col("_base") + F.col(residual)).drop("_base")


def antisymmetric(forward: DataFrame, keys: list[str], a: str, b: str, value: str) -> DataFrame:
    """(f(A, B) - f(B, A)) / 2 of a frame with both directions."""
    back = forward.select(*keys, F.col(a).alias(b), F.col(b).alias(a), F.col(value).alias("_back"))
    return forward.join(back, [*keys, a, b]).withColumn(value, (F.col(value) - F.col("_back")) / 2).drop("_back")


def reversed_copies(pairs: DataFrame, swap: list[tuple[str, str]], negate: list[str]) -> DataFrame:
    """pairs and their mirror images: columns swapped, differences negated."""
    names = {x: y for a, b in swap for x, y in ((a, b), (b, a))}
    return pairs.unionByName(pairs.select(*((-F.col(c) if c in negate else F.col(names.get(c, c))).alias(c) for c in pairs.columns)))


def transitive_scores(pairs: DataFrame, keys: list[str], a: str, b: str, value: str) -> DataFrame:
    """Least-squares item scores of the pair values of each key: score_a - score_b is nearest to value, scores of a component sum to 0.

    Conjugate gradients on the pairs themselves, for all keys of a batch at once: no matrix of items is made, and a task holds a batch and the
    pairs of one key that goes on in the next."""
    import numpy as np
    import pandas as pd

    def solve(rows: pd.DataFrame, key: np.ndarray) -> pd.DataFrame:
        ends = pd.DataFrame({"key": np.concatenate([key, key]), "item": pd.concat([rows[a], rows[b]], ignore_index=True)})
        at = ends.groupby(["key", "item"], sort=False, dropna=False).ngroup().to_numpy()
        i, j, n = at[: len(rows)], at[len(rows) :], at.max() + 1
        named = np.unique(at, return_index=True)[1]
        of, m = ends["key"].to_numpy()[named], key.max() + 1
        spread = lambda v: np.bincount(i, v, n) - np.bincount(j, v, n)
        left = spread(rows[value].to_numpy(float))
        score, way, size = np.zeros(n), left.copy(), np.bincount(of, left * left, m)
        score[np.isnan(size[of])] = np.nan
        least, most, turn = 1e-26 * size, 20 * np.bincount(of, minlength=m), 0
        while (live := (size > least) & (turn < most)).any():
            turned = spread(way[i] - way[j])
            step = np.divide(size, np.bincount(of, way * turned, m), out=np.zeros(m), where=live)[of]
            score += step * way
            left = left - step * turned
            size, before = np.bincount(of, left * left, m), size
            way = left + np.divide(size, before, out=np.zeros(m), where=live)[of] * way
            turn += 1
        out = rows[keys].iloc[named % len(rows)].reset_index(drop=True)
        out["item"], out["score"] = ends["item"].to_numpy()[named], score
        return out

    def run(batches):
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            key = rows.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            last = np.flatnonzero(key == key[-1])[0] if len(rows) else 0  # rows are in the order of keys
            held = rows.iloc[last:]
            if last:
                yield solve(rows.iloc[:last].reset_index(drop=True), key[:last])
        if held is not None and len(held):
            yield solve(held.reset_index(drop=True), np.zeros(len(held), dtype=int))

    kinds = dict(pairs.dtypes)
    dealt = pairs.select(*keys, a, b, value).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", item {kinds[a]}, score double")


def seed_ensemble(runs: DataFrame, expected: int, row: str | list[str] = "row_id", seed: str = "seed", value: str = "oof") -> DataFrame:
    """Mean over all seeds. A seed given twice for a row, or a value that is not finite, is an error; rows without every seed are left out.

    row: its columns, if the first of them has already dealt the rows. Means and checks come of one pass."""
    rows = [row] if isinstance(row, str) else row
    odd = (F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).cast("int")
    seeds = F.size(F.array_distinct(F.collect_list(F.struct(seed))))
    by = stored(runs.groupBy(*rows).agg(F.avg(value).alias(value), F.count("*").alias("_n"), seeds.alias("_seeds"), F.max(odd).alias("_odd")))
    bad = by.filter("_n > _seeds or _odd = 1").take(1)
    if bad:
        own = runs
        for c in rows:
            own = own.filter(F.col(c).eqNullSafe(F.lit(bad[0][c])))
        first = own.groupBy(seed).agg(F.count("*").alias("n"), F.max(odd).alias("odd")).filter("n > 1 or odd = 1").first()
        raise ValueError(f"row {bad[0][rows[-1]]!r}, seed {first[seed]!r}: {'given twice' if first['n'] > 1 else 'not finite'}")
    return by.filter(F.col("_n") == expected).select(*rows, value)


def disagreement(df: DataFrame, arms: list[str]) -> DataFrame:
    """Population SD over the arms of a row."""
    mean = sum(F.col(a) for a in arms) / len(arms)
    return df.withColumn("disagreement", F.sqrt(sum((F.col(a) - mean) ** 2 for a in arms) / len(arms)))


def combined(df: DataFrame, arms: list[str], y: str = "y", group: str = "grp") -> DataFrame:
    """mean, inverse-variance and best-single combinations, with weights from the other groups; inverse variance shrinks to the grand mean where arms disagree."""
    own = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(y).alias("_y"), *(F.sum((F.col(y) - F.col(a)) ** 2).alias(f"_e{k}") for k, a in enumerate(arms)))
    whole = own.agg(F.sum("_n").alias("_tn"), F.sum("_y").alias("_ty"), *(F.sum(f"_e{k}").alias(f"_t{k}") for k in range(len(arms))))
    t = own.crossJoin(F.broadcast(whole)).select(group, ((F.col("_ty") - F.col("_y")) / F.nullif(F.col("_tn") - F.col("_n"), F.lit(0))).alias("_mean"), *((F.col(f"_t{k}") - F.col(f"_e{k}")).alias(f"_r{k}") for k in range(len(arms))))
    df = disagreement(df, arms).join(t, group)
    weight = sum(ratio(F.lit(1.0), f"_r{k}") for k in range(len(arms)))
    inverse = sum(F.col(a) * ratio(F.lit(1.0), f"_r{k}") for k, a in enumerate(arms)) / weight
    best = F.least(*(F.col(f"_r{k}") for k in range(len(arms))))
    single = F.coalesce(*(F.when(F.col(f"_r{k}") == best, F.col(a)) for k, a in enumerate(arms)))
    keep = 1 / (1 + F.col("disagreement") ** 2)
    return df.withColumns({"mean": sum(F.col(a) for a in arms) / len(arms), "inverse_variance": F.col("_mean") + keep * (inverse - F.col("_mean")), "best_single": single}).drop("_mean", *(f"_r{k}" for k in range(len(arms))))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank statistic: sums of the average ranks of absolute differences, zeros left out."""
    return _signed_ranks(df, a, b).select("n", "w_plus", "w_minus")


def _signed_ranks(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0").withColumn("ad", F.round(F.abs("d"), 9))
    by = d.groupBy("ad").agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("up"))
    r = value_ranks(by, "ad", "n")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    ties = zero((F.pow("n", F.lit(3.0)) - F.col("n")) / 48)
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), zero(F.col("rank") * F.col("up")).alias("w_plus"), zero(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), ties.alias("_ties"))


def wilcoxon_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, w_plus, w_minus, z, p: the signed-rank statistic by the normal law, its variance less that of ties; null without differences."""
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties")
    out = _signed_ranks(df, a, b).withColumn("z", ratio(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(var)))
    return out.select("n", "w_plus", "w_minus", "z", F.when(F.col("z").isNotNull(), normal_tails(F.col("z"))).alias("p"))
