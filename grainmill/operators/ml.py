"""Model zoo on pyspark.ml and the learners of this package, grouped cross-validation, feature selection and permutation importance.

Models are named; an unknown name, or a model that cannot take sample weights, is an error rather than a silent refit without them.
Fits run on the cluster; the driver only loops over folds. Missing features are imputed by the training fold's medians.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..functions.scalars import hash32, r2
from ..sources.files import stored
from .boosting import LEARNERS, boost
from .neighbours import knn_cv
from .perceptron import mlp
from .resampling import hash_folds
from .support import svr


def _zoo() -> dict[str, Callable]:
    from pyspark.ml.regression import DecisionTreeRegressor, FMRegressor, GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor

    return {
        "linear": lambda **p: LinearRegression(**p),
        "ridge": lambda regParam=1e-2, **p: LinearRegression(regParam=regParam, elasticNetParam=0.0, **p),
        "elasticnet": lambda regParam=1e-2, elasticNetParam=0.5, **p: LinearRegression(regParam=regParam, elasticNetParam=elasticNetParam, **p),
        "huber": lambda epsilon=1.35, **p: LinearRegression(loss="huber", epsilon=epsilon, **p),
        "glm": lambda **p: GeneralizedLinearRegression(**p),
        "tree": lambda maxDepth=5, **p: DecisionTreeRegressor(maxDepth=maxDepth, **p),
        "rf": lambda numTrees=20, maxDepth=5, seed=0, **p: RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, seed=seed, **p),
        "extratrees": lambda numTrees=20, maxDepth=8, seed=0, **p: RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, seed=seed, featureSubsetStrategy="onethird", subsamplingRate=1.0, **p),
        "gbt": lambda maxIter=20, maxDepth=4, seed=0, **p: GBTRegressor(maxIter=maxIter, maxDepth=maxDepth, seed=seed, **p),
        "fm": lambda seed=0, **p: FMRegressor(seed=seed, **p),
    }


#: Search spaces of the model's parameters, by name.
SPACES = {"ridge": {"regParam": [1e-3, 1e-2, 1e-1]}, "elasticnet": {"regParam": [1e-3, 1e-2], "elasticNetParam": [0.2, 0.8]}, "rf": {"numTrees": [20, 50], "maxDepth": [4, 6]}, "gbt": {"maxIter": [10, 20], "maxDepth": [3, 5]}}
WEIGHTED = {"linear", "ridge", "elasticnet", "huber", "glm", "tree", "rf", "extratrees", "gbt"}


def make_model(name: str, weight: str | None = None, **params):
    zoo = _zoo()
    if name not in zoo:
        raise KeyError(f"no model {name!r}; there are {sorted([*zoo, *LEARNERS, *OWN])}, of which {sorted([*LEARNERS, *OWN])} are fitted by grouped_cv()")
    if weight and name not in WEIGHTED:
        raise ValueError(f"model {name!r} takes no sample weights")
    extra = {"weightCol": weight} if weight else {}
    return zoo[name](featuresCol="_features", labelCol="y", predictionCol="_prediction", **extra, **params)


def pipeline(name: str, features: list[str], weight: str | None = None, scale: bool = False, **params):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"_f_{c}" for c in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "_features")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_features", withMean=True))
    return Pipeline(stages=[*stages, make_model(name, weight, **params)])


@dataclass(frozen=True)
class Deal:
    """Rows with their fold, a stored table a repeat, and whether no row_id occurs twice."""

    parts: list[DataFrame]
    unique: bool
    rows: int = 0


def deal(df: DataFrame, folds: int = 5, repeats: int = 1, seed: str = "0") -> Deal:
    """The folds of grouped_cv(), which several models may share: df is computed once. That ids differ is seen by their 64-bit hashes; where two of these meet, it is not taken for granted."""
    df = stored(df)
    n = df.count()
    twice = spread(df.select(F.xxhash64(F.col("row_id").cast("string")).alias("h")), n, "h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    return Deal([stored(spread(df, n, "grp").join(hash_folds(df, folds, f"{seed}|{rep}"), "grp")) for rep in range(repeats)], twice.isEmpty(), n)


def _deal(df: DataFrame, options: dict) -> Deal:
    return deal(df, **{k: options[k] for k in ("folds", "repeats", "seed") if k in options})


def grouped_cv(df: DataFrame, name: str, features: list[str], folds: int = 5, repeats: int = 1, seed: str = "0", weight: str | None = None, clip: float | None = None, dealt: Deal | None = None, **params) -> DataFrame:
    """row_id, y, grp, oof: out-of-fold predictions averaged over repeats; groups never lie on both sides. clip winsorises the training target from below.

    dealt: what deal() made of df with the same folds, repeats and seed. One prediction a row needs no average, so its rows are not shuffled again."""
    out, whole = None, dealt or deal(df, folds, repeats, seed)
    for rep, dealt in enumerate(whole.parts):
        if name in LEARNERS or name in OWN:
            one = _at_once(dealt, name, features, folds, f"{seed}|{rep}", weight, clip, params)
            out = one if out is None else out.unionByName(one)
            continue
        if name in ON_SUMS and set(params) <= ON_SUMS[name] and (equal := _equal_rows(dealt, features)) is not None:
            one = _on_sums(dealt, equal, name, features, folds, weight, clip, **params)
            out = one if out is None else out.unionByName(one)
            continue
        for k in range(folds):
            train = dealt.filter(F.col("fold") != k)
            if clip is not None:
                train = train.withColumn("y", F.greatest("y", F.lit(-abs(clip))))
            one = pipeline(name, features, weight, **params).fit(train).transform(dealt.filter(F.col("fold") == k)).select("row_id", "y", "grp", F.col("_prediction").alias("oof"))
            out = one if out is None else out.unionByName(one)
    if whole.unique and repeats == 1:
        return out.select("row_id", "y", "grp", "oof")
    return spread(out, whole.rows * repeats, "row_id").groupBy("row_id").agg(F.first("y").alias("y"), F.first("grp").alias("grp"), F.avg("oof").alias("oof"))


#: Models whose trees need sums of equal rows only, and the parameters for which that holds.
ON_SUMS = {"gbt": {"maxIter", "maxDepth", "seed"}, "rf": {"numTrees", "maxDepth", "seed"}}

#: Rows to a different one of their features, from which on trees grow on sums.
CROWDED = 8


def _equal_rows(dealt: DataFrame, features: list[str]) -> DataFrame | None:
    """The features' different rows and their number `_n`, if there are few of them beside all rows."""
    equal = stored(dealt.groupBy(*features).agg(F.count("*").alias("_n")))
    size = equal.agg(F.count("*").alias("rows"), F.sum("_n").alias("all")).first()
    return equal if size["rows"] and size["rows"] * CROWDED <= size["all"] else None


def _poisson(row: str, salt: str) -> Column:
    """How often a row is drawn with replacement, by hash: Poisson of mean 1."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(row), F.lit(salt)), 11) / F.lit(float(1 << 53))
    below, term, out = 0.0, math.exp(-1), None
    for n in range(18):
        below += term
        term /= n + 1
        out = F.when(u < below, float(n)) if out is None else out.when(u < below, float(n))
    return out.otherwise(18.0)


def _on_sums(dealt: DataFrame, equal: DataFrame, name: str, features: list[str], folds: int, weight: str | None, clip: float | None, **params) -> DataFrame:
    """row_id, y, grp, oof of trees that are fitted on a weight and a mean target for each different row of the features.

    Variance inside equal rows adds the same to a node and to its parts, and residuals of squared loss are linear in the target, so splits and leaves are those of
    the rows themselves; but split candidates come of all different rows, not of a sample. A forest's bootstrap draws rows, so each of its trees has sums of its own."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler

    y = F.col("y") if clip is None else F.greatest("y", F.lit(-abs(clip)))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    seed, trees = params.get("seed", 0), params.get("numTrees", 20) if name == "rf" else 1
    drawn = dealt.withColumns({"_y": y, "_w": w, "_h": F.xxhash64(F.col("row_id").cast("string"))})
    times = [F.col("_w") * _poisson("_h", f"{seed}|{t}") for t in range(trees)] if name == "rf" else [F.col("_w")]
    names = [(f"_w{t}", f"_s{t}") for t in range(trees)]
    drawn = drawn.select("fold", *features, "_y", *(x.alias(n) for x, (n, _) in zip(times, names, strict=True)))
    sums = stored(drawn.groupBy("fold", *features).agg(F.count_if(F.col("_y").isNull() | F.isnan("_y")).alias("_odd"), *(c for n, s in names for c in (F.sum(n).alias(n), F.sum(F.col(n) * F.col("_y")).alias(s)))).coalesce(8))
    if not sums.filter("_odd > 0").isEmpty():
        raise ValueError("labels must not be null or NaN")
    lacking = F.lit(False)
    for c in features:
        lacking = lacking | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    whole = equal.filter(lacking).isEmpty()  # then no medians of all rows are needed
    filled, found = [f"_f_{c}" for c in features], None
    grown = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "onethird" if trees > 1 else "all"} if name == "rf" else {}
    for k in range(folds):
        imputer = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(sums.limit(1) if whole else dealt.filter(F.col("fold") != k))
        full = Pipeline(stages=[imputer, VectorAssembler(inputCols=filled, outputCol="_features")]).fit(sums)
        train = stored(full.transform(sums.filter(F.col("fold") != k)).groupBy("_features").agg(*(F.sum(c).alias(c) for pair in names for c in pair)).coalesce(8))
        held, marks = full.transform(sums.filter(F.col("fold") == k)).select("fold", *features, "_features"), []
        for t, (n, s) in enumerate(names):
            model = make_model(name, "_weight", **{**params, **grown, "seed": seed + t}).setPredictionCol(f"_p{t}")
            held = model.fit(train.filter(F.col(n) > 0).select("_features", F.col(n).alias("_weight"), (F.col(s) / F.col(n)).alias("y"))).transform(held)
            marks.append(F.col(f"_p{t}"))
        one = held.select("fold", *features, (sum(marks) / len(marks)).alias("oof"))
        found = one if found is None else found.unionByName(one)
    found = stored(found.select(F.col("fold").alias("_fold"), *(F.col(c).alias(f"_x_{c}") for c in features), "oof"))
    on = F.col("fold") == F.col("_fold")
    for c in features:
        on = on & F.col(c).eqNullSafe(F.col(f"_x_{c}"))
    return dealt.join(found, on).select("row_id", "y", "grp", "oof")


#: Learners of this package besides the boosters; they take no sample weights.
OWN: dict[str, Callable] = {
    "knn": lambda d, x, folds, **p: knn_cv(d, x, **p),
    "svr": lambda d, x, folds, **p: svr(d, x, folds, **p)[1],
    "mlp": lambda d, x, folds, **p: mlp(d, x, folds, **p)[1],
}


def _at_once(dealt: DataFrame, name: str, features: list[str], folds: int, seed: str, weight: str | None, clip: float | None, params: dict) -> DataFrame:
    """row_id, y, grp, oof of a learner that fits all folds at once."""
    if name in OWN and weight:
        raise ValueError(f"model {name!r} takes no sample weights")
    train = dealt if clip is None else dealt.withColumn("y", F.greatest("y", F.lit(-abs(clip))))
    found = OWN[name](train, features, folds, **params) if name in OWN else boost(train, features, replace(LEARNERS[name], **{"seed": seed, **params}), folds, weight)[1]
    found = found.select("row_id", "y", "grp", "oof")
    if clip is None:
        return found
    return found.drop("y").join(dealt.select(F.col("row_id").cast("string").alias("row_id"), "y"), "row_id").select("row_id", "y", "grp", "oof")


def cv_score(df: DataFrame, name: str, features: list[str], **kwargs) -> float:
    return grouped_cv(df, name, features, **kwargs).agg(r2("y", "oof").alias("x")).first()["x"]


def search(df: DataFrame, name: str, features: list[str], trials: int = 8, seed: str = "0", **kwargs) -> list[tuple[dict, float]]:
    """A fixed random part of the model's grid, best first: trials are taken in the order of their hash."""
    space = SPACES[name]
    grid = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    grid.sort(key=lambda p: hashlib.md5(f"{seed}|{sorted(p.items())}".encode()).hexdigest())
    dealt = _deal(df, kwargs)
    return sorted(((p, cv_score(df, name, features, dealt=dealt, **kwargs, **p)) for p in grid[:trials]), key=lambda x: -x[1])


#: Continuous and whole-number ranges of the study: (low, high, whole, by powers of ten).
RANGES = {"ridge": {"regParam": (1e-4, 1.0, False, True)}, "elasticnet": {"regParam": (1e-4, 1.0, False, True), "elasticNetParam": (0.0, 1.0, False, False)}, "rf": {"numTrees": (10, 60, True, False), "maxDepth": (3, 8, True, False)}, "gbt": {"maxIter": (5, 30, True, False), "maxDepth": (2, 5, True, False)}}


def propose(space: dict[str, tuple], done: list[tuple[dict, float]], number: int, seed: str = "0", start: int = 5, candidates: int = 24) -> dict:
    """Parameters of the next trial: by hash at first, then the candidate that lies densest among the best quarter of trials against the rest (a tree of Parzen estimators)."""
    import numpy as np

    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}|{number}".encode()).digest()[:8], "big"))
    unit = {k: (lambda v, s=s: (math.log10(v) - math.log10(s[0])) / (math.log10(s[1]) - math.log10(s[0])) if s[3] else (v - s[0]) / (s[1] - s[0])) for k, s in space.items()}

    def value(k: str, u: float):
        low, high, whole, logs = space[k]
        v = 10 ** (math.log10(low) + u * (math.log10(high) - math.log10(low))) if logs else low + u * (high - low)
        return int(round(v)) if whole else float(v)

    if len(done) < start:
        return {k: value(k, float(rng.random())) for k in space}
    ranked = sorted(done, key=lambda x: -x[1])
    cut = max(1, len(ranked) // 4)
    out = {}
    for k in space:
        good, rest = (np.array([unit[k](p[k]) for p, _ in part]) for part in (ranked[:cut], ranked[cut:]))
        width = max(0.05, 1 / math.sqrt(len(done)))
        trial = np.clip(rng.choice(good, candidates) + rng.normal(size=candidates) * width, 0, 1)
        density = lambda at: np.exp(-((trial[:, None] - at[None]) ** 2) / (2 * width * width)).mean(1) + 1e-12  # noqa: B023, E731
        out[k] = value(k, float(trial[np.argmax(density(good) / density(rest))]))
    return out


def study(df: DataFrame, name: str, features: list[str], trials: int, store: str, seed: str = "0", score: Callable | None = None, **kwargs) -> list[tuple[dict, float]]:
    """Trials of a model's parameters, best first. Each finished trial is a line of JSON in the store, so a study that was cut short goes on where it stopped."""
    spark = df.sparkSession
    dealt = []  # once, and only if a trial is left

    def scored(params: dict) -> float:
        if not dealt:
            dealt.append(_deal(df, kwargs))
        return cv_score(df, name, features, dealt=dealt[0], **kwargs, **params)

    score = score or scored
    schema = "number int, model string, seed string, params string, score double"
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    held = spark.read.schema(schema).json(store).collect() if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else []
    found = {r["number"]: (json.loads(r["params"]), r["score"]) for r in held if r["model"] == name and r["seed"] == seed}
    for number in range(trials):
        if number not in found:
            params = propose(RANGES[name], [found[k] for k in sorted(found) if k < number], number, seed)
            found[number] = (params, float(score(params)))
            spark.createDataFrame([(number, name, seed, json.dumps(params), found[number][1])], schema).coalesce(1).write.mode("append").json(store)
    return sorted(found.values(), key=lambda x: -x[1])


def forward_blocks(df: DataFrame, name: str, blocks: dict[str, list[str]], tolerance: float = 1e-3, **kwargs) -> list[tuple[str, float]]:
    """Blocks of features in the order in which they raise the score, until none adds more than the tolerance."""
    chosen, best, dealt = [], float("-inf"), _deal(df, kwargs)
    while len(chosen) < len(blocks):
        trials = {b: cv_score(df, name, [c for x in [*(c for c, _ in chosen), b] for c in blocks[x]], dealt=dealt, **kwargs) for b in blocks if b not in dict(chosen)}
        block = max(trials, key=lambda b: (trials[b], b))
        if trials[block] <= best + tolerance:
            break
        best = trials[block]
        chosen.append((block, best))
    return chosen


def permuted_in_folds(dealt: DataFrame, features: list[str], seed: str = "0") -> DataFrame:
    """fold, y, the features, and each of them shuffled inside its fold as `_m_<name>`, as resampling.permuted() would do fold by fold: a row's place by one hash meets the value of the row with that place by another.

    Places are given for all folds at once and to one feature at a time; what is joined are places and values, not names and rows."""
    dealt = stored(dealt.select("row_id", "fold", "y", *features))

    def places(values: list[str], salt: str, name: str) -> DataFrame:
        h = hash32(F.concat_ws("|", F.lit(salt), "row_id"))
        binned = dealt.select("fold", *(x for x in ("y", *values) if x in values or name == "_k"), "row_id", h.alias("_h"), F.shiftright(h, 18).alias("_bin"))
        before = binned.groupBy("fold", "_bin").agg(F.count("*").alias("_s"))
        before = before.select("fold", "_bin", (F.sum("_s").over(Window.partitionBy("fold").orderBy("_bin")) - F.col("_s")).alias("_before"))  # 16,384 rows a fold
        inside = F.row_number().over(Window.partitionBy("fold", "_bin").orderBy("_h", "row_id", *values)) - 1
        return binned.withColumn("_n", inside).join(F.broadcast(before), ["fold", "_bin"]).withColumn(name, F.col("_before") + F.col("_n")).drop("_h", "_bin", "_before", "_n", "row_id")

    out = places(features, "rows", "_k")
    for c in features:
        out = out.join(places([c], f"{seed}|{c}", "_k2").select("fold", F.col("_k2").alias("_k"), F.col(c).alias(f"_m_{c}")), ["fold", "_k"])
    return out.drop("_k")


def permutation_importance(df: DataFrame, name: str, features: list[str], folds: int = 3, seed: str = "0", **params) -> DataFrame:
    """feature, drop: loss of R2 when a feature is shuffled inside the held-out fold, by rank of a hash."""
    mixed = stored(permuted_in_folds(df.join(hash_folds(df, folds, seed), "grp"), features, seed))
    scored = None
    for k in range(folds):
        model = pipeline(name, features, **params).fit(mixed.filter(F.col("fold") != k).select("y", *features))
        held = mixed.filter(F.col("fold") == k)
        for c in ["", *features]:
            one = model.transform(held.select("y", *(F.col(f"_m_{x}" if x == c else x).alias(x) for x in features))).select(F.lit(c).alias("feature"), "y", F.col("_prediction").alias("p"))
            scored = one if scored is None else scored.unionByName(one)
    by = scored.groupBy("feature").agg(r2("y", "p").alias("r2"))
    base = by.filter("feature = ''").select(F.col("r2").alias("_base"))
    return by.filter("feature <> ''").crossJoin(F.broadcast(base)).select("feature", (F.col("_base") - F.col("r2")).alias("drop"))


def antisymmetric_cv(pairs: DataFrame, name: str, left: list[str], right: list[str], **kwargs) -> DataFrame:
    """Pair predictions from a model trained on pairs and mirror images: (f(A, B) - f(B, A)) / 2, by row and group."""
    from .predict import reversed_copies

    features = [*left, *right]
    both = reversed_copies(pairs.withColumn("_way", F.lit(1.0)), list(zip(left, right, strict=True)), ["y", "_way"]).withColumn("row_id", F.concat_ws("|", F.col("row_id").cast("string"), F.col("_way").cast("string")))
    dealt = kwargs.pop("dealt", None) or _deal(both, kwargs)
    out = grouped_cv(both, name, features, dealt=dealt, **kwargs)
    way = F.when(F.col("row_id").endswith("|1.0"), 1.0).otherwise(-1.0)
    row = F.regexp_replace("row_id", r"\|-?1\.0$", "")
    turned = out.select(row.alias("row_id"), (way * F.col("oof")).alias("v"), (way * F.col("y")).alias("y"))
    return spread(turned, dealt.rows, "row_id").groupBy("row_id").agg(F.avg("y").alias("y"), F.avg("v").alias("oof"))


def shuffled_control(df: DataFrame, name: str, features: list[str], seed: str = "0", **kwargs) -> tuple[float, float]:
    """(score, score after the target is shuffled among all rows): the second should be near or below 0."""
    from .resampling import permuted

    mixed = permuted(df, "row_id", "y", seed, []).drop("y").withColumnRenamed("y_shuffled", "y")
    return cv_score(df, name, features, **kwargs), cv_score(mixed, name, features, **kwargs)
