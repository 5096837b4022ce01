"""Moment tables, and what follows from them: leave-one-group-out by total less own, bootstraps by multiplicity, nested grids.

A pair statistic over rows is a function of sums by group, so each group's rows are read once. Draws and grids are then joined with the table of
groups, whose cost does not depend on the number of pairs. A group drawn twice counts twice.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import ordered_digest
from ..functions.hashes import Tails, digits, hash32_rows
from ..functions.ranks import numbered, placed
from ..functions.scalars import hash32, ratio
from ..sources.files import stored

# ---- moments


def moments(pairs: DataFrame, y: str, arms: list[str], keys: list[str]) -> DataFrame:
    """n, s (sum of y), yy, s_k, y_k, j_k by key: all second moments of y and the arms. y counts from its global mean, as the sums would cancel otherwise.

    One pass: the mean comes from the keys' own sums, and moves the keys' stable variances and covariances."""
    n = F.count("*")
    agg = [n.alias("n"), F.avg(y).alias("_my"), (F.var_pop(y) * n).alias("_yy")]
    agg += [F.sum(a).alias(f"s_{a}") for a in arms]
    agg += [(F.covar_pop(y, a) * n).alias(f"_y_{a}") for a in arms]
    agg += [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in itertools.combinations_with_replacement(arms, 2)]
    by = pairs.groupBy(*keys).agg(*agg)
    mean = by.agg(ratio(F.sum(F.col("n") * F.col("_my")), F.sum("n")).alias("m"))
    off = F.col("_my") - F.col("m")
    cross = [F.col(f"{a}_{b}") for a, b in itertools.combinations_with_replacement(arms, 2)]
    return by.crossJoin(F.broadcast(mean)).select(*keys, "n", (F.col("n") * off).alias("s"), (F.col("_yy") + F.col("n") * off * off).alias("yy"), "m", *(F.col(f"s_{a}") for a in arms), *((F.col(f"_y_{a}") + off * F.col(f"s_{a}")).alias(f"y_{a}") for a in arms), *cross)


def less_own(groups: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Each group with total minus own of some columns, as rest_<column>; the total is that of all groups, or of those of one stratum."""
    whole = (groups.groupBy(by) if by else groups).agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    both = groups.join(F.broadcast(whole), by) if by else groups.crossJoin(F.broadcast(whole))
    return both.select("*", *((F.col(f"_t_{c}") - F.col(c)).alias(f"rest_{c}") for c in columns)).drop(*(f"_t_{c}" for c in columns))


def arm_moments(pairs: DataFrame, y: str = "dy", arms: tuple[str, ...] = ("dp",), keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """n, sy, syy and each arm's squared error by key, y counted from its global mean; one pass. Stored, as draws and scores both read it: a row a key."""
    n = F.count("*")
    by = pairs.groupBy(*keys).agg(n.alias("n"), F.avg(y).alias("_my"), (F.var_pop(y) * n).alias("_yy"), *(F.sum((F.col(y) - F.col(a)) ** 2).alias(f"e_{a}") for a in arms))
    mean = by.agg(ratio(F.sum(F.col("n") * F.col("_my")), F.sum("n")).alias("_m"))
    off = F.col("_my") - F.col("_m")
    return stored(by.crossJoin(F.broadcast(mean)).select(*keys, "n", (F.col("n") * off).alias("sy"), (F.col("_yy") + F.col("n") * off * off).alias("syy"), *(f"e_{a}" for a in arms)))


def weighted_r2_of(weight: Column, arm: str) -> Column:
    n, sy, syy, e = (F.sum(weight * F.col(c)) for c in ("n", "sy", "syy", f"e_{arm}"))
    return 1 - ratio(e, syy - sy * sy / F.nullif(n.cast("double"), F.lit(0.0)))


# ---- draws


def in_order(groups: DataFrame, key: str = "grp") -> tuple[DataFrame, int]:
    """(groups with their place _k, from 0, in the order of key, nulls last; how many there are). A row a group; ranges are sorted apart, so no task has all names."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(stored(groups).repartitionByRange(parts, F.asc_nulls_last(key)).withColumn("_bin", F.spark_partition_id()))
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_c"))
    ahead = stored(counts.select(F.col("_bin").alias("_at"), "_c", (F.sum("_c").over(Window.orderBy("_bin")) - F.col("_c")).alias("_ahead")))  # a row a partition
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("_bin").orderBy(F.asc_nulls_last(key))) - 1
    return rows.join(F.broadcast(ahead), F.col("_bin") == F.col("_at")).withColumn("_k", place).drop("_bin", "_at", "_c", "_ahead"), ahead.agg(F.sum("_c")).first()[0] or 0


def draws(groups: DataFrame, n_draws: int, seed: str, key: str = "grp", collapse: bool = False) -> DataFrame:
    """draw, key, times: as many groups as there are, drawn with replacement by hash. collapse is the audit form in which repeats count once.

    A row a draw and group: drawn_sums() is for sums over the groups."""
    names, n = in_order(groups.select(key).distinct(), key)
    slots = groups.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    picked = slots.select("draw", (hash32(F.concat_ws("|", F.lit(seed), "draw", "slot")) % F.lit(n)).alias("_k"))
    times = picked.groupBy("draw", "_k").agg(F.count("*").alias("times"))
    if collapse:
        times = times.withColumn("times", F.lit(1).cast("long"))
    return times.hint("shuffle_hash").join(names.filter(F.col(key).isNotNull()), "_k").select("draw", key, "times")


#: Groups of one block of drawn_sums(), slots hashed at a time, draws of one task at most, and bytes of values that a task holds.
BLOCK, SLOTS_AT_ONCE, DRAWS_A_TASK, HELD = 65_536, 65_536, 256, 160 << 20


def _apart(spark: SparkSession, tasks: int) -> list[int]:
    """Numbers of which each falls into a partition of its own, of so many, when rows are shuffled by them."""
    found = spark.range(64 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("_to")).agg(F.min("id").alias("_id")).collect()  # one row a task
    return [r["_id"] for r in found]


def drawn_sums(by: DataFrame, columns: list[str], n_draws: int, seed: str, key: str = "grp", collapse: bool = False) -> DataFrame:
    """draw, times, columns: sums over the groups of each draw, a group as often as drawn; times is the number of groups drawn. The draws are those of draws(); by has a row a group.

    Groups are numbered in order and packed into blocks. Each task gets the values of all groups, or of so many blocks as HELD bytes hold, and a band of
    draws: it hashes their slots, some at a time, and adds up the values where these point. Neither slots nor counts leave it, only a row a draw. More
    groups than one task holds are hashed once for each such part. Null values add nothing."""
    import pandas as pd

    spark, width = by.sparkSession, len(columns)
    rows, n = in_order(by.select(key, *(F.col(c).cast("double").alias(c) for c in columns)), key)
    named = rows.filter(F.col(key).isNotNull()).select((F.col("_k") % BLOCK).cast("int").alias("_place"), F.floor(F.col("_k") / BLOCK).alias("_block"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((width + 1, int(rows["_place"].max()) + 1))
        values[0, rows["_place"]], values[1:, rows["_place"]] = 1, rows[columns].T
        return pd.DataFrame({"_block": rows["_block"][:1], "_values": [values.tobytes()]})

    block_size, slots, most = BLOCK, SLOTS_AT_ONCE, HELD
    held = max(1, most // (8 * block_size * (width + 1)))
    room = held * block_size
    parts = max(1, -(-n // room))
    some = min(DRAWS_A_TASK, max(1, -(-n_draws // (2 * spark.sparkContext.defaultParallelism))))
    bands = -(-n_draws // some)
    at = sorted(_apart(spark, bands * parts))
    blocks = stored(named.groupBy("_block").applyInPandas(pack, "_block long, _values binary"))
    task = F.element_at(F.lit(at), (F.floor(F.col("_block") / held) * bands + F.col("_band") + 1).cast("int"))
    sent = blocks.withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("_task", task)
    batch_of = {t: divmod(k, bands) for k, t in enumerate(at)}

    def add(name: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, band = batch_of[name[0].as_py()]
        low, size = part * room, min(room, n - part * room)
        values = np.zeros((width + 1, size))
        for batch in batches:
            for block, packed in zip(batch["_block"].to_pylist(), batch["_values"], strict=True):
                one = np.frombuffer(packed.as_buffer()).reshape(width + 1, -1)
                values[:, block * block_size - low :][:, : one.shape[1]] = one
        same = [float(v[0]) if np.isfinite(v[0]) and v.min() == v.max() else None for v in values]
        draws = np.arange(band * some, min((band + 1) * some, n_draws))
        sums = np.zeros((width + 1, len(draws)))
        step = max(1, most // size) if collapse else len(draws)
        for begin in range(0, len(draws), step):
            seen = np.zeros((len(draws[begin : begin + step]), size), dtype=bool) if collapse else None
            for first in range(0, n, slots):
                for _, slot in digits(np.arange(first, min(first + slots, n))):
                    tails = Tails(slot)
                    for row, draw in enumerate(draws[begin : begin + step].tolist()):
                        k = tails.hash32(f"{seed}|{draw}|".encode())
                        k = (k % np.uint32(n) if n >> 32 == 0 else k).astype(np.int64)
                        if parts > 1:
                            k = k[(k >= low) & (k < low + size)] - low
                        if collapse:
                            seen[row, k] = True
                            continue
                        for v, alike, total in zip(values, same, sums, strict=True):
                            total[begin + row] += v.take(k).sum() if alike is None else alike * len(k)
            if collapse:
                for row, on in enumerate(seen):
                    sums[:, begin + row] = values[:, on].sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(draws), *map(pa.array, sums)], names=["draw", "times", *columns])

    schema = "draw long, " + ", ".join(f"{c} double" for c in ("times", *columns))
    sums = sent.repartition(bands * parts, "_task").groupBy("_task").applyInArrow(add, schema)
    return sums.groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("times", *columns))).filter("times > 0")


def bootstrap(by_group: DataFrame, arms: list[str], n_draws: int, seed: str, key: str = "grp", collapse: bool = False) -> DataFrame:
    """R2 of each arm in each draw of draws(), from the groups' moments."""
    sums = drawn_sums(by_group, ["n", "sy", "syy", *(f"e_{a}" for a in arms)], n_draws, seed, key, collapse)
    left = F.col("syy") - F.col("sy") * F.col("sy") / F.nullif(F.col("n"), F.lit(0.0))
    return sums.select("draw", *((1 - ratio(f"e_{a}", left)).alias(a) for a in arms))


def bootstrap_r2(by_group: DataFrame, drawn: DataFrame, arms: list[str], key: str = "grp") -> DataFrame:
    """R2 of each arm in each draw."""
    w = F.col("times").cast("double")
    return drawn.join(by_group, key).groupBy("draw").agg(*(weighted_r2_of(w, a).alias(a) for a in arms))


def interval(samples: DataFrame, column: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return samples.agg(F.percentile(column, F.lit(low)).alias("lo"), F.percentile(column, F.lit(high)).alias("hi"), F.avg(F.when(F.col(column) > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("share_positive"))


#: Hashes that a task of hashed_sums() takes at once.
HASHES = 65_536


def hashed_sums(by: DataFrame, columns: list[str], n_draws: int, seed: str, modulus: int, below: int, key: str = "grp", index: str | None = None) -> DataFrame:
    """draw, index, inside, columns: sums over the groups whose hash of seed, draw and key, modulo `modulus`, is below `below`, and over the others.

    Each task multiplies its groups' values with their places in the draws and sends a row a draw, index and side, not one a group and draw. by has
    a row a group and index; indices are few (one a position of a series)."""
    rows = by.select(F.col(key).cast("string").alias("_k"), (F.col(index) if index else F.lit(0)).cast("long").alias("_i"), *(F.col(c).cast("double").alias(c) for c in columns))
    parts = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        totals: dict[int, np.ndarray] = {}
        head, numbers = np.frombuffer(f"{seed}|".encode(), dtype=np.uint8), digits(np.arange(n_draws))
        for batch in batches:
            names, at = np.unique(np.array(batch.column("_k").to_pylist(), dtype=object), return_inverse=True)
            inside = np.empty((n_draws, len(names)), dtype=bool)
            tails = [f"|{name}".encode() for name in names]
            for length in {len(t) for t in tails}:
                those = [g for g, t in enumerate(tails) if len(t) == length]
                tail = np.frombuffer(b"".join(tails[g] for g in those), dtype=np.uint8).reshape(len(those), length)
                for drawn, draw in numbers:
                    step = max(1, HASHES // len(those))
                    for k in range(0, len(drawn), step):
                        some = draw[k : k + step]
                        rows = np.empty((len(some), len(those), len(head) + some.shape[1] + length), dtype=np.uint8)
                        rows[:, :, : len(head)], rows[:, :, len(head) : -length], rows[:, :, -length:] = head, some[:, None], tail
                        inside[np.ix_(drawn[k : k + step], those)] = (hash32_rows(rows.reshape(-1, rows.shape[2])) % modulus < below).reshape(len(some), -1)
            value = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            place = batch.column("_i").to_numpy(zero_copy_only=False)
            for i in np.unique(place):
                on = place == i
                both = totals.setdefault(int(i), np.zeros((2, n_draws, len(columns))))
                mask = inside[:, at[on]].astype(float)
                both[1] += mask @ value[on]
                both[0] += (1 - mask) @ value[on]
        for i, both in totals.items():
            for side in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_draws)), pa.array(np.full(n_draws, i)), pa.array(np.full(n_draws, bool(side))), *(pa.array(both[side, :, c]) for c in range(len(columns)))], names=["draw", "index", "inside", *columns])

    sums = rows.repartition(parts, "_k").mapInArrow(run, "draw long, index long, inside boolean, " + ", ".join(f"{c} double" for c in columns))
    return sums.groupBy("draw", "index", "inside").agg(*(F.sum(c).alias(c) for c in columns))


def spearman_brown(r: Column) -> Column:
    return ratio(2 * r, 1 + r)


# ---- folds and splits


def hash_folds(df: DataFrame, k: int, seed: str, key: str = "grp") -> DataFrame:
    """Groups ranked by hash, rank mod k: folds differ by one group at most."""
    names = df.select(key).distinct()
    return numbered(names, hash32(F.concat_ws("|", F.lit(seed), key)), key).withColumn("fold", (F.col("_k") % k).cast("int")).drop("_k")


def in_turn(groups: DataFrame, deal, schema: str) -> DataFrame:
    """What deal makes of the rows of groups, in a task of its own: for rules in which each group's part depends on those dealt before.

    Groups are few beside their rows; they come to one executor, not to the driver."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(deal(list(rows.drop(columns="_one").itertuples(index=False, name=None))), columns=names)

    return groups.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(run, schema)


def balanced_folds(sizes: list[tuple[str, int]], k: int) -> dict[str, int]:
    """Groups by falling size, each to the lightest fold. Group sizes come to the driver."""
    load, out = [0] * k, {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[name] = f
        load[f] += size
    return out


def stratified_folds(sizes: list[tuple[str, str, int]], k: int) -> dict[str, int]:
    """Groups with counts by stratum: each to the fold where the spread of stratum shares grows least."""
    strata, names = sorted({s for _, s, _ in sizes}), sorted({g for g, _, _ in sizes})
    row, column = ({x: n for n, x in enumerate(of)} for of in (names, strata))
    by = np.zeros((len(names), len(strata)))
    for g, s, n in sizes:
        by[row[g], column[s]] += n
    return dict(zip(names, _stratified(by, k).tolist(), strict=True))


def _stratified(by: np.ndarray, k: int) -> np.ndarray:
    """The fold of each row of by, which has the counts of a group by stratum; rows are in the order of names, which breaks ties."""
    strata = by.shape[1]
    total, loads = np.maximum(by.sum(0), 1), [0.0] * k
    load, every, own, out = np.zeros((k, strata)), np.empty((k, k, strata)), np.arange(k), np.zeros(len(by), dtype=np.int32)
    for g in np.lexsort((np.arange(len(by)), -by.sum(1), -by.std(1))):
        every[:] = load
        every[own, own] += by[g]  # trial f has the group in fold f
        share = every / total
        apart = share - (np.add.reduce(share, 1) / k)[:, None]
        spread = np.add.reduce(np.sqrt(np.add.reduce(apart * apart, 1) / k), 1) / strata
        out[g] = f = min(zip(spread.tolist(), loads, range(k), strict=True))[2]
        load[f] += by[g]
        loads[f] = load[f].sum()
    return out


def stratified_fold_table(counts: DataFrame, k: int, key: str = "grp", stratum: str = "stratum", n: str = "n") -> DataFrame:
    """key, fold by stratified_folds(), from a row a group and stratum (null is one, the last): in one executor task, which holds the names and a number a group and stratum."""

    def run(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = rows.combine_chunks()
        names, strata = (pc.unique(rows[c]).sort() for c in ("_g", "_s"))
        by = np.zeros((len(names), len(strata)))
        np.add.at(by, tuple(pc.index_in(rows[c], of).to_numpy() for c, of in (("_g", names), ("_s", strata))), rows["_n"].to_numpy())
        return pa.table([names, pa.array(_stratified(by, k))], names=[key, "fold"])

    return counts.select(F.lit(1).alias("_one"), F.col(key).alias("_g"), F.col(stratum).alias("_s"), F.col(n).alias("_n")).groupBy("_one").applyInArrow(run, f"{key} {dict(counts.dtypes)[key]}, fold int")


def even_split(counts: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Two sides of like pair counts: the next group by falling count goes to the lighter side, groups without pairs alternate."""
    sides: tuple[list[str], list[str]] = ([], [])
    load, turn = [0, 0], 0
    for name, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        side = (0 if load[0] <= load[1] else 1) if n else turn % 2
        turn += not n
        sides[side].append(name)
        load[side] += n
    return sides


def snake_draft(counts: DataFrame, n: str, parts: int = 3, key: str = "grp") -> DataFrame:
    """key, part: parts pick in turn, forwards and backwards, by falling count and then name."""
    order = placed(counts.select(key, (-F.col(n)).cast("double").alias("_c")), "_c", key)
    turn = F.col("_r") % parts
    return order.select(key, F.when(F.floor(F.col("_r") / parts) % 2 == 0, turn).otherwise(parts - 1 - turn).cast("int").alias("part"))


def lightest(k: int):
    """The rule that gives a group to the lightest of k parts, the first of equal ones, and its first state: the loads less the least."""

    def rule(state: tuple, n: int) -> tuple[int, tuple]:
        part = state.index(min(state))
        loads = [x + n * (i == part) for i, x in enumerate(state)]
        return part, tuple(x - min(loads) for x in loads)

    return rule, (0,) * k


def alternating(k: int = 2):
    """lightest(k), but groups of size 0 take turns."""
    light, start = lightest(k)

    def rule(state: tuple, n: int) -> tuple[int, tuple]:
        loads, turn = state
        if not n:
            return turn, (loads, (turn + 1) % k)
        part, loads = light(loads, n)
        return part, (loads, turn)

    return rule, (start, 0)


#: Slots of the three-way draft: the first part picks twice as often, forwards and backwards.
SLOTS = (0, 0, 1, 2, 2, 1, 0, 0)


def draft(slots: tuple[int, ...] = SLOTS):
    """A group goes to the part of its slot, unless that part is ahead of the lightest by more than the group: then to the lightest. Groups of size 0 take turns."""
    k = max(slots) + 1

    def rule(state: tuple, n: int) -> tuple[int, tuple]:
        loads, at, turn = state
        if not n:
            return turn, (loads, at, (turn + 1) % k)
        part = slots[at]
        if loads[part] > min(loads) + n:
            part = loads.index(min(loads))
        new = [x + n * (i == part) for i, x in enumerate(loads)]
        return part, (tuple(x - min(new) for x in new), (at + 1) % len(slots), turn)

    return rule, ((0,) * k, 0, 0)


def pattern(rule, state: tuple, n: int, times: int) -> tuple[list[int], list[int], tuple]:
    """(first parts, then repeating parts, state after) of dealing `times` groups of size n: states come again, so a run of any length is short."""
    seen, parts = {state: 0}, []
    while len(parts) < times:
        part, state = rule(state, n)
        parts.append(part)
        if state in seen:
            first = seen[state]
            for _ in range((times - first) % (len(parts) - first)):
                state = rule(state, n)[1]
            return parts[:first], parts[first:], state
        seen[state] = len(parts)
    return parts, [], state


def dealt(groups: DataFrame, n: str, ruled: tuple, key: str = "grp") -> DataFrame:
    """key, part: groups by falling n and then name, one after the other by a rule and its first state.

    One task runs the rule over the table of sizes, a row a size, and leaves a pattern for each; a group's part is read off at its rank
    among those of its size. Ranks come from a sort by ranges, so no task has all groups."""
    rule, start = ruled
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(groups.select(key, F.col(n).cast("long").alias("_n")).repartitionByRange(parts, F.desc("_n"), F.asc(key)).withColumn("_bin", F.spark_partition_id()))
    sizes = rows.groupBy("_n").agg(F.count("*").alias("_times"))

    def run(batches):
        import pyarrow as pa

        state, before = start, 0
        for batch in batches:
            out = []
            for size, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, cycle, state = pattern(rule, state, size, times)
                out.append((size, before, first, cycle))
                before += times
            if out:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_s", "_start", "_first", "_cycle"])

    patterns = sizes.repartition(1).sortWithinPartitions(F.desc("_n")).mapInArrow(run, "_s long, _start long, _first array<int>, _cycle array<int>")
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_c"))
    ahead = counts.select(F.col("_bin").alias("_at"), (F.sum("_c").over(Window.orderBy("_bin")) - F.col("_c")).alias("_ahead"))  # a row a partition
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("_bin").orderBy(F.desc("_n"), key)) - 1
    met = rows.join(F.broadcast(ahead), F.col("_bin") == F.col("_at")).withColumn("_k", place).join(patterns, F.col("_n") == F.col("_s"))
    rank, first = F.col("_k") - F.col("_start"), F.size("_first")
    later = F.get("_cycle", (F.pmod(rank - first, F.greatest(F.size("_cycle"), F.lit(1)))).cast("int"))
    return met.select(key, F.when(rank < first, F.get("_first", rank.cast("int"))).otherwise(later).alias("part"))


def digest(df: DataFrame, part: str, key: str) -> DataFrame:
    """SHA-256 of each part's sorted keys, a line each; keys are hashed as a stream in the order of their bytes."""
    return ordered_digest(stored(df.select(part, key)), [part], [key], F.col(key), "\n")


def permuted(df: DataFrame, row: str, column: str, seed: str, by: list[str]) -> DataFrame:
    """column shuffled inside each key: rank by row meets rank by hash. Without keys two hashes rank all rows, by bins of the hash."""
    mixed = hash32(F.concat_ws("|", F.lit(seed), row))
    if not by:
        a = numbered(df, hash32(F.concat_ws("|", F.lit("rows"), row)), row, column)
        b = numbered(df.select(row, F.col(column).alias(f"{column}_shuffled")), mixed, row, f"{column}_shuffled", name="_j").drop(row)
        return a.join(b, F.col("_k") == F.col("_j")).drop("_k", "_j")
    a = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(row, column)))
    b = df.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col(column).alias(f"{column}_shuffled"), F.row_number().over(Window.partitionBy(*by).orderBy(mixed, row, column)).alias("_j"))
    on = (F.col("_k") == F.col("_j")) & _all(F.col(c) == F.col(f"_b_{c}") for c in by)
    return a.join(b, on).drop("_k", "_j", *(f"_b_{c}" for c in by))


def _all(tests) -> Column:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


# ---- grids


def simplex(arms: int, steps: int) -> list[tuple[float, ...]]:
    """All weights that are multiples of 1 / steps and add to 1."""
    return [tuple(x / steps for x in w) for w in itertools.product(range(steps + 1), repeat=arms) if sum(w) == steps]


def grid(spark: SparkSession, weights: list[tuple[float, ...]]) -> DataFrame:
    return spark.createDataFrame([(k, *map(float, w)) for k, w in enumerate(weights)], "k int, " + ", ".join(f"w{j} double" for j in range(len(weights[0]))))


def error_of_blend(arms: list[str], prefix: str = "") -> Column:
    """Squared error of the arms weighted by w0, w1, ... from moments (y about m)."""
    c = lambda x: F.col(prefix + x)
    out = c("yy") + 2 * F.col("m") * c("s") + F.col("m") ** 2 * c("n")
    for j, a in enumerate(arms):
        out = out - 2 * F.col(f"w{j}") * (c(f"y_{a}") + F.col("m") * c(f"s_{a}"))
        for k, b in enumerate(arms):
            pair = f"{a}_{b}" if j <= k else f"{b}_{a}"
            out = out + F.col(f"w{j}") * F.col(f"w{k}") * c(pair)
    return out


def nested_blend(by_group: DataFrame, arms: list[str], weights: list[tuple[float, ...]], key: str = "grp") -> DataFrame:
    """For each group the weights with the least error on the others (the first of equals), and its own error under them."""
    sums = [c for c in by_group.columns if c not in (key, "m")]
    table = less_own(by_group, sums).crossJoin(F.broadcast(grid(by_group.sparkSession, weights)))
    scored = table.select(key, "k", *(f"w{j}" for j in range(len(arms))), "n", "s", "yy", "m", error_of_blend(arms, "rest_").alias("_rest"), error_of_blend(arms).alias("sse"))
    return scored.groupBy(key).agg(F.min_by(F.struct("k", *(f"w{j}" for j in range(len(arms))), "sse", "n", "s", "yy"), F.struct(F.round("_rest", 9), "k")).alias("b")).select(key, "b.*")


def nnls(gram: np.ndarray, rhs: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Non-negative least squares by projected gradient on the normal equations, scaled to sum to 1."""
    return _nnls(np.asarray(gram, float)[None], np.asarray(rhs, float)[None], ridge)[0]


def _nnls(gram: np.ndarray, rhs: np.ndarray, ridge: float = 1e-6, sweeps: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """nnls() of many systems at once: projected gradient steps, one weight at a time with its own exact step, until none moves."""
    k = rhs.shape[1]
    a = gram + ridge * np.eye(k)
    w = np.full(rhs.shape, 1 / k)
    for _ in range(sweeps):
        before = w.copy()
        for j in range(k):
            w[:, j] = np.maximum(0, w[:, j] - (np.einsum("nk,nk->n", a[:, j], w) - rhs[:, j]) / np.maximum(a[:, j, j], 1e-12))
        if np.abs(w - before).max(initial=0) <= tolerance:
            break
    total = w.sum(1, keepdims=True)
    return np.where(total > 0, w / np.where(total > 0, total, 1), 1 / k)


def nnls_of_rest(table: DataFrame, arms: list[str], keys: list[str], least: int = 20) -> DataFrame:
    """keys, w0, w1, ...: nnls() of each row's rest_ moments, as less_own() gives them, all rows of a batch at once; fewer than `least` rows there give equal weights."""
    import pandas as pd

    kinds = dict(table.dtypes)

    def run(batches):
        for rows in batches:
            n = len(rows)
            gram = np.empty((n, len(arms), len(arms)))
            for j, x in enumerate(arms):
                for k, z in enumerate(arms):
                    gram[:, j, k] = rows[f"rest_{x}_{z}" if j <= k else f"rest_{z}_{x}"]
            rhs = np.stack([rows[f"rest_y_{x}"] + rows["m"] * rows[f"rest_s_{x}"] for x in arms], 1).astype(float)
            w = _nnls(gram, rhs)
            w[rows["rest_n"].to_numpy() < least] = 1 / len(arms)
            yield pd.DataFrame({**{k: rows[k] for k in keys}, **{f"w{j}": w[:, j] for j in range(len(arms))}})

    return table.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"w{j} double" for j in range(len(arms))]))


def gram_of(row: dict, arms: list[str], prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and right-hand side from a row of moments."""
    a = np.array([[row[prefix + (f"{x}_{z}" if j <= k else f"{z}_{x}")] for k, z in enumerate(arms)] for j, x in enumerate(arms)])
    return a, np.array([row[f"{prefix}y_{x}"] + row["m"] * row[f"{prefix}s_{x}"] for x in arms])
