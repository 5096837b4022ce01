"""Filters, guarded joins, group-broadcast windows, picks and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed
from ..functions.joins import with_group
from ..functions.scalars import is_true, ratio
from ..sources.files import stored

# ---- filters and projections


def row_filter(df: DataFrame, name: str, filters: dict[str, Column]) -> DataFrame:
    """df by a named predicate; an unknown name is an error."""
    if name not in filters:
        raise KeyError(f"no row filter {name!r}; there are {sorted(filters)}")
    return df.filter(filters[name])


def preset(df: DataFrame, blocks: dict[str, list[str]], names: str) -> DataFrame:
    """The columns of blocks joined by "+"; a block or column that is missing is an error."""
    columns = [c for b in names.split("+") for c in blocks[b]]
    if gone := [c for c in columns if c not in df.columns]:
        raise KeyError(f"columns not found: {gone}")
    return df.select(*dict.fromkeys(columns))


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))


def quarantine(df: DataFrame, name_col: str, key_col: str, name: str) -> DataFrame:
    """df without rows that carry the commonest key of a name but not the name."""
    modal = df.filter(F.col(name_col) == name).groupBy(key_col).agg(F.count("*").alias("n")).agg(F.max_by(key_col, F.struct("n", key_col)).alias("_modal"))
    return df.crossJoin(F.broadcast(modal)).filter(~((F.col(key_col) == F.col("_modal")) & (F.col(name_col) != name)) | F.col("_modal").isNull()).drop("_modal")


def covered_columns(df: DataFrame, columns: list[str], most_missing: float) -> list[str]:
    """Columns whose share of nulls is below a bound, from one pass."""
    row = df.agg(*(F.avg(is_true(F.col(c).isNull())).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] < most_missing]


def supported(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    return df.join(df.groupBy(*keys).count().filter(F.col("count") >= least).select(*keys), keys, "left_semi")


def rejected_range(df: DataFrame, column: str, most: float) -> tuple[DataFrame, DataFrame]:
    """(rows within the range, counts of kept and dropped rows)."""
    inside = F.abs(F.col(column)) <= most
    return df.filter(inside), df.agg(F.count(F.when(inside, 1)).alias("kept"), F.count(F.when(~inside, 1)).alias("dropped"))


def match_sizes(heavy: list[tuple[str, int]], light: list[tuple[str, int]], seed: str) -> list[tuple[str, str]]:
    """For each heavy group by falling size the unused light group nearest in size; ties by MD5 of seed and name.

    Light groups wait by size in the order of their MD5. The nearest size that still has one is found by links that skip the empty ones, so a
    match looks at two sizes, however many groups there are."""
    import hashlib
    from bisect import bisect_left

    tie = lambda name: hashlib.md5(f"{seed}|{name}".encode()).hexdigest()
    waiting: dict[int, list] = {}
    for name, size in dict(light).items():
        waiting.setdefault(size, []).append((tie(name), name))
    for names in waiting.values():
        names.sort(reverse=True)
    sizes = sorted(waiting)
    queues = [waiting[x] for x in sizes]
    below, above = list(range(-1, len(sizes))), list(range(len(sizes) + 1))  # place k of sizes is k + 1 in below, where 0 is none, and k in above, where the last is none

    def end(link: list[int], k: int, step: int) -> int:
        path = []
        while link[k] != k - (step < 0):
            path.append(k)
            k = link[k] + (step < 0)
        for p in path:
            link[p] = k - (step < 0)
        return k - (step < 0)

    out = []
    for name, size in sorted(heavy, key=lambda x: (-x[1], tie(x[0]))):
        at = bisect_left(sizes, size)
        found = [k for k in (end(below, at, -1), end(above, at, 1)) if 0 <= k < len(sizes)]
        if not found:
            break
        best = min(found, key=lambda k: (abs(sizes[k] - size), queues[k][-1][0]))
        out.append((name, queues[best].pop()[1]))
        if not queues[best]:
            below[best + 1], above[best] = below[best], best + 1
    return out


# ---- joins


def overlap_join(a: DataFrame, b: DataFrame, key: str, floor: float = 0.5) -> DataFrame:
    """Inner join, empty when the common keys are fewer than a share of the smaller side's."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    common = ka.join(kb, key).agg(F.count("*").alias("both"))
    gate = common.crossJoin(ka.agg(F.count("*").alias("na"))).crossJoin(kb.agg(F.count("*").alias("nb"))).select((F.col("both") >= floor * F.least("na", "nb")).alias("_open"))
    return a.join(b, key).crossJoin(F.broadcast(gate)).filter("_open").drop("_open")


def backfill(df: DataFrame, dimension: DataFrame, key: str, order: str) -> DataFrame:
    """Left join of the dimension's first row a key, adding only columns that df lacks."""
    new = [c for c in dimension.columns if c not in df.columns and c != order]
    one = dimension.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in new))
    return df.join(one, key, "left")


def total_join(df: DataFrame, dimension: DataFrame, key: str, column: str) -> DataFrame:
    """Left join that raises when a key finds nothing."""
    out = df.join(dimension.select(key, column), key, "left")
    if (n := out.filter(F.col(column).isNull()).count()):
        raise ValueError(f"{n} rows have no {column}")
    return out


def covered_join(df: DataFrame, dimension: DataFrame, key: str, floor: float = 0.95) -> DataFrame:
    """Left join that raises when fewer than a share of rows find a match."""
    out = df.join(dimension.withColumn("_hit", F.lit(True)), key, "left")
    share = out.agg(F.avg(is_true(F.col("_hit").isNotNull())).alias("x")).first()["x"]
    if share is not None and share < floor:
        raise ValueError(f"only {share:.1%} of rows match on {key}")
    return out.drop("_hit")


def sign_aligned(a: DataFrame, b: DataFrame, keys: list[str], dy: str, dy2: str, dp: str) -> DataFrame:
    """b's values with the sign that makes its differences agree with a's."""
    return a.join(b, keys, "left").withColumn(dp, F.when(F.signum(dy) != F.signum(dy2), -F.col(dp)).otherwise(F.col(dp)))


def fallback_join(df: DataFrame, dimension: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """By the first key, else by the second; the provenance says which."""
    one = dimension.groupBy(first).agg(F.min(value).alias("_v1"))
    two = dimension.groupBy(second).agg(F.min(value).alias("_v2"))
    out = df.join(one, first, "left").join(two, second, "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).withColumn("provenance", F.when(F.col("_v1").isNotNull(), first).when(F.col("_v2").isNotNull(), second)).drop("_v1", "_v2")


def radius_join(points: DataFrame, radius: float, key: str = "build_id") -> DataFrame:
    """Pairs i < j of one build within a radius, in three dimensions, by grid cells of that side: a point meets the 27 cells around it."""
    cell = [F.floor(F.col(c) / radius).cast("long") for c in "xyz"]
    a = points.select(key, F.col("i"), *(F.col(c).alias(f"a{c}") for c in "xyz"), *(k.alias(f"g{c}") for k, c in zip(cell, "xyz", strict=True)))
    near = [F.explode(F.array(*(F.col(f"g{c}") + d for d in (-1, 0, 1)))).alias(f"g{c}") for c in "xyz"]
    b = a.withColumnsRenamed({"i": "j", **{f"a{c}": f"b{c}" for c in "xyz"}})
    for k, c in enumerate("xyz"):
        b = b.select(*[x for x in b.columns if x != f"g{c}"], near[k])
    d = F.sqrt(sum((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"))
    return a.join(b, [key, "gx", "gy", "gz"]).filter("i < j").select(key, "i", "j", d.alias("dist")).filter(F.col("dist") <= radius)


#: Finest halving of a build's side whose cells are counted.
HALVINGS = 20


def near_pairs(points: DataFrame, k: int, key: str = "build_id", digits: int = 9) -> DataFrame:
    """key, i, j, dist of each point's k nearest in three dimensions (all, where a build has fewer), dist rounded, ties by j; points without finite coordinates are left out.

    A build's cube is halved again and again. The finest cell of a point that holds k + 1 points bounds its k-th distance by the cell's diagonal, so the
    27 cells of twice that side around it hold the answer; where no such cell is small enough, the whole build does. Equal points are one site, which is
    searched once and found by its k + 1 smallest ids. Crowds of different points inside a 2^-20th of the side are compared with each other."""
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    zero = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)).alias(c)  # noqa: E731  -0.0 is 0.0
    order = F.row_number().over(Window.partitionBy(key, *"xyz").orderBy("i"))
    every = stored(points.filter(finite).select(key, "i", *(zero(c) for c in "xyz")).withColumn("_r", order))
    box = every.groupBy(key).agg(*(F.min(c).alias(f"l{c}") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("side"))
    side = F.when(F.col("side") > 0, F.col("side") * (1 + 1e-9)).otherwise(1.0)
    fine = [F.floor((F.col(c) - F.col(f"l{c}")) / side * (1 << HALVINGS)).cast("long").alias(f"g{c}") for c in "xyz"]
    kept = stored(every.filter(F.col("_r") <= k + 1).join(box, key).select(key, "i", *"xyz", "_r", side.alias("side"), *fine))
    cell = [F.expr(f"shiftright(g{c}, {HALVINGS} - level)").alias(f"c{c}") for c in "xyz"]
    at = ["level", "cx", "cy", "cz"]
    levels = kept.withColumn("level", F.explode(F.sequence(F.lit(2), F.lit(HALVINGS)))).select(key, "i", "_r", *"xyz", "level", *cell)
    full = levels.groupBy(key, *at).agg(F.count("*").alias("n")).filter(F.col("n") > k).drop("n")
    own = levels.filter("_r = 1").join(full, [key, *at], "left_semi").groupBy(key, "i").agg(F.max("level").alias("level"))
    sites = kept.filter("_r = 1").join(own, [key, "i"], "left").withColumn("level", F.coalesce(F.col("level") - 1, F.lit(0)))
    reach = F.when(F.col("level") > 0, F.col("side") * F.expr("pow(2.0D, -1 - level)") * 1.7320508076 * (1 + 1e-9) + 10.0**-digits).otherwise(float("inf"))
    sites = stored(sites.select(key, F.col("i").alias("site"), *(F.col(c).alias(f"a{c}") for c in "xyz"), "level", reach.alias("reach"), *cell))
    used = [r["level"] for r in sites.select("level").distinct().collect()]  # at most HALVINGS
    asked = sites
    for c in "xyz":
        step = F.when(F.col("level") == 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, (-1, 0, 1))))
        asked = asked.withColumn("_d", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_d")).drop("_d")
    there = kept.withColumn("level", F.explode(F.array(*map(F.lit, used or [0])))).select(key, F.col("i").alias("j"), *"xyz", "level", *cell)
    raw = F.sqrt(sum((F.col(f"a{c}") - F.col(c)) ** 2 for c in "xyz"))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of one's own: both sides are small beside what they make
    met = asked.repartition(parts, key, *at).join(there.repartition(parts, key, *at), [key, *at]).filter(raw <= F.col("reach")).select(key, "site", "j", F.round(raw, digits).alias("dist"))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy(key, "site").orderBy("dist", "j"))).filter(F.col("_n") <= k + 1).select(key, "site", "j", "dist")
    named = every.select(key, "i", *"xyz").join(sites.select(key, "site", *(F.col(f"a{c}").alias(c) for c in "xyz")), [key, *"xyz"]).select(key, "i", "site")
    out = named.join(best, [key, "site"]).filter("i <> j")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key, "i").orderBy("dist", "j"))).filter(F.col("_n") <= k).select(key, "i", "j", "dist")


def nearest_graph(distances: DataFrame, k: int, key: str = "build_id") -> DataFrame:
    """Undirected edges i < j from each node's k nearest, ties by number; distances holds both directions."""
    rank = F.row_number().over(Window.partitionBy(key, "i").orderBy("dist", "j"))
    near = distances.withColumn("_r", rank).filter(F.col("_r") <= k)
    return near.select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist").distinct()


# ---- windows and picks


def standing(df: DataFrame, family: str, column: str) -> DataFrame:
    """Delta from the family's mean, z-score and rank."""
    w = Window.partitionBy(family)
    mean = F.avg(column).over(w)
    return df.withColumns({f"{column}_delta": F.col(column) - mean, f"{column}_z": ratio(F.col(column) - mean, F.stddev_samp(column).over(w)), f"{column}_rank": F.rank().over(w.orderBy(column))})


def family_line(df: DataFrame, family: str, x: str, y: str) -> DataFrame:
    """Slope, mean and fitted value of a family's line, beside each row."""
    fit = df.groupBy(family).agg(F.regr_slope(y, x).alias("slope"), F.avg(y).alias("mean"), F.avg(x).alias("_mx"))
    return df.join(fit, family).withColumn("fitted", F.col("mean") + F.col("slope") * (F.col(x) - F.col("_mx"))).drop("_mx")


def without_main_effect(df: DataFrame, key: str, column: str) -> DataFrame:
    """column less its key's mean plus the grand mean."""
    whole = df.agg(F.avg(column).alias("_m"))
    return with_group(df, key, {"_g": F.avg(column)}).crossJoin(F.broadcast(whole)).withColumn(column, F.col(column) - F.col("_g") + F.col("_m")).drop("_m", "_g")


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def capped_top(df: DataFrame, key: str, order: list, each: int, most: int) -> DataFrame:
    """The best rows: at most `each` a key, `most` overall."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= each).drop("_r").orderBy(*order).limit(most)


def middle_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The element (n - 1) // 2 of each group."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).filter(F.col("_r") == F.floor((F.col("_n") - 1) / 2) + 1).drop("_r", "_n")


def decile_pick(df: DataFrame, size: str, order: str, each: int = 3, strata: int = 10) -> DataFrame:
    """`each` rows of every stratum by size, evenly spaced: the k-th of stratum s has rank round-down of k x rows / each. Places of a stratum
    follow from those among all rows, so no stratum is gathered."""
    ranked = placed(df, size, order).withColumn("stratum", F.floor(F.col("_r") * strata / F.col("_all")).cast("int"))
    first = lambda s: F.ceil(s * F.col("_all") / strata)  # noqa: E731  the least place of a stratum
    ranked = ranked.withColumns({"_k": F.col("_r") - first(F.col("stratum")), "_m": first(F.col("stratum") + 1) - first(F.col("stratum"))})
    return ranked.filter(F.floor(F.col("_k") * each / F.col("_m")) != F.floor((F.col("_k") - 1) * each / F.col("_m"))).drop("_r", "_k", "_m", "_all")


def interleaved(df: DataFrame, bucket: str, order: list) -> DataFrame:
    """Rows with their turn: the first of each bucket, then the second of each, and so on."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).orderBy("turn", bucket)


def representatives(df: DataFrame, ligand: str, family: str, member: str, n: int) -> DataFrame:
    """Of each ligand its largest family, of that its smallest member; the first n ligands by family size."""
    sizes = df.groupBy(ligand, family).agg(F.count("*").alias("size"), F.min(member).alias("member"))
    best = first_rows(sizes, [ligand], [F.desc("size"), F.col(family)])
    return best.orderBy(F.desc("size"), ligand).limit(n)


# ---- sorts, deltas and sets


def delta_to_reference(df: DataFrame, name: str, reference: str, column: str) -> DataFrame:
    ref = df.filter(F.col(name) == reference).agg(F.max(column).alias("_ref"))
    return df.crossJoin(F.broadcast(ref)).withColumn("delta", F.col(column) - F.col("_ref")).drop("_ref")


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value, null being one."""
    row = df.agg(*(((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*")))).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def edge_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of two edge sets, of their symmetric difference, and its share of the union."""
    both = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full")
    odd = F.col("_a").isNull() | F.col("_b").isNull()
    return both.agg(F.count("_a").alias("left_edges"), F.count("_b").alias("right_edges"), F.count(F.when(odd, 1)).alias("different"), F.avg(is_true(odd)).alias("share"))


def split_check(parts: DataFrame, part: str, key: str, whole: DataFrame) -> DataFrame:
    """Keys in more than one part, keys of the whole in none, and keys of parts outside the whole."""
    by = parts.groupBy(key).agg(F.count_distinct(part).alias("_k"))
    both = by.join(whole.select(key).distinct().withColumn("_w", F.lit(1)), key, "full")
    return both.agg(F.count(F.when(F.col("_k") > 1, 1)).alias("shared"), F.count(F.when(F.col("_k").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_w").isNull(), 1)).alias("foreign"))


def block_matrix(cells: DataFrame, block: str, indices: list[int], value: str) -> DataFrame:
    """A row a block with a column an index; blocks without all of them are dropped."""
    by = cells.groupBy(block).agg(*(F.max(F.when(F.col("idx") == i, F.col(value))).alias(f"i{i}") for i in indices))
    return by.dropna()
