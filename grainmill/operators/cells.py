"""Cells and pairs: replicates collapse to cells, and cells of one block pair up.

Frames carry the columns of roles.Roles: row_id, grp, blk, strict_blk, idx and value columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..functions.scalars import hash32
from ..sources.files import stored


def collapse(df: DataFrame, values: list[str], block: str = "blk", keys: tuple[str, ...] = ("grp",), rows: int = 0) -> DataFrame:
    """A mean a value, block and index; dealt by block once, so what works inside blocks afterwards shuffles nothing. rows: about how many there are, if they may be too many for the session's number of partitions."""
    by = [*[k for k in keys if k != block], block]
    thin = df.select(*by, "idx", *values)
    dealt = spread(thin, rows, block)
    return (dealt if dealt is not thin else thin.repartition(block)).groupBy(*by, "idx").agg(*(F.avg(v).alias(v) for v in values))


def collapse_mixed(df: DataFrame, means: list[str], firsts: list[str], order: str, block: str = "blk") -> DataFrame:
    """Means of some columns and, of others, the value of the row first by order."""
    return df.groupBy("grp", block, "idx").agg(*(F.avg(v).alias(v) for v in means), *(F.min_by(v, order).alias(v) for v in firsts), F.count("*").alias("replicates"))


def collapse_median(df: DataFrame, medians: list[str], alls: list[str], order: str, firsts: list[str], block: str = "blk") -> DataFrame:
    """Medians, first by order, all-true flags and the number of replicates; null keys are a cell of their own."""
    return df.groupBy("grp", block, "idx").agg(*(F.percentile(v, F.lit(0.5)).alias(v) for v in medians), *(F.min_by(v, order).alias(v) for v in firsts), *(F.bool_and(v).alias(v) for v in alls), F.count("*").alias("replicates"))


def adjacent(cells: DataFrame, values: list[str], block: str = "blk", keep: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Differences, low minus high, of cells whose indices follow each other: no self-join, one sort inside the block."""
    w = Window.partitionBy(*[k for k in keep if k != block], block).orderBy("idx")
    after = cells.withColumns({"_next": F.lead("idx").over(w), **{f"_{v}": F.lead(v).over(w) for v in values}})
    after = after.filter(F.col("_next") - F.col("idx") == 1)
    return after.select(*keep, *([block] if block not in keep else []), F.col("idx").alias("lo"), F.col("_next").alias("hi"), *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def adjacent_by_join(cells: DataFrame, values: list[str], block: str = "blk") -> DataFrame:
    """The same pairs as an equi-join on block and index."""
    high = cells.select(F.col(block).alias("_b"), (F.col("idx") - 1).alias("_i"), *(F.col(v).alias(f"_{v}") for v in values))
    return cells.join(high, (F.col(block) == F.col("_b")) & (F.col("idx") == F.col("_i"))).select("grp", block, F.col("idx").alias("lo"), (F.col("idx") + 1).alias("hi"), *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def all_pairs(cells: DataFrame, values: list[str], block: str = "blk") -> DataFrame:
    """Differences of all pairs lo < hi of a block."""
    other = cells.select(F.col(block).alias("_b"), F.col("idx").alias("hi"), *(F.col(v).alias(f"_{v}") for v in values))
    return cells.join(other, (F.col(block) == F.col("_b")) & (F.col("idx") < F.col("hi"))).select("grp", block, F.col("idx").alias("lo"), "hi", (F.col("hi") - F.col("idx")).alias("gap"), *((F.col(v) - F.col(f"_{v}")).alias(f"d_{v}") for v in values))


def ordered_pairs(rows: DataFrame, value: str, most: int, block: str = "blk", order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Ordered pairs i <> j of a block's rows; of a block with more than `most`, which is a sampling limit, that many at random.

    A block's pairs are numbered, and numbers are drawn by hash before any rows are paired: of at most 8 x `most` pairs by rank of their hash, of
    more by 2 x `most` + 16 draws, the first `most` different ones of which stand. So the work is bounded by `most` a block, not by its square."""
    by = tuple(f"_o{k}" for k in range(len(order)))
    named = rows.select(F.col(block).alias("blk"), F.col("row_id").alias("id"), F.col(value).alias("v"), *(F.col(c).alias(o) for c, o in zip(order, by, strict=True)))
    large = stored(named.groupBy("blk").agg(F.count("*").alias("n")).filter(F.col("n") * (F.col("n") - 1) > 8 * most).select("blk"))
    if large.isEmpty():
        return _pairs_of_small(named, most, by)
    small = _pairs_of_small(named.join(large, "blk", "left_anti"), most, by)
    return small.unionByName(_pairs_of_any(stored(named.join(large, "blk", "left_semi")), most, by))


def _pairs_of_small(named: DataFrame, most: int, by: tuple[str, ...]) -> DataFrame:
    """ordered_pairs of blocks with at most 8 x `most` pairs: a block is an array, from which pairs are taken where it lies. Rows are shuffled once, by block."""
    rows = named.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct(*by, "id", "v"))).alias("rows"), F.count("*").alias("n")).filter("n > 1")
    pick = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") * (F.col("n") - 1) - 1), lambda t: F.struct(hash32(F.concat_ws("|", F.col("blk"), t.cast("string"))).alias("at"), t.alias("k")))
    taken = rows.select("blk", "rows", "n", F.explode(F.slice(F.array_sort(pick), 1, most)).alias("p")).select("blk", "rows", "n", F.col("p.k").alias("k"))
    left, right = F.floor(F.col("k") / (F.col("n") - 1)).cast("int"), (F.col("k") % (F.col("n") - 1)).cast("int")
    ends = taken.select("blk", F.col("rows")[left].alias("a"), F.col("rows")[right + (right >= left).cast("int")].alias("b"))
    return ends.select("blk", F.col("a.id").alias("i"), F.col("b.id").alias("j"), (F.col("a.v") - F.col("b.v")).alias("delta"))


def _pairs_of_any(named: DataFrame, most: int, by: tuple[str, ...]) -> DataFrame:
    """ordered_pairs of blocks of any size: rows are numbered in windows and joined with the pairs that are drawn."""
    w = Window.partitionBy("blk")
    numbered = named.select("blk", "id", "v", (F.row_number().over(w.orderBy(*by)) - 1).cast("long").alias("r"))
    blocks = numbered.groupBy("blk").agg(F.count("*").alias("n")).filter("n > 1").withColumn("pairs", F.col("n") * (F.col("n") - 1))
    few = F.col("pairs") <= 8 * most
    slots = blocks.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.when(few, F.col("pairs")).otherwise(2 * most + 16) - 1)))
    hashed = hash32(F.concat_ws("|", "blk", F.col("t").cast("string")))
    drawn = slots.select("blk", "n", F.when(few, F.col("t")).otherwise(hashed % F.col("pairs")).alias("k"), F.when(few, hashed).otherwise(F.col("t")).alias("at")).groupBy("blk", "n", "k").agg(F.min("at").alias("at"))
    taken = drawn.withColumn("_r", F.row_number().over(w.orderBy("at", "k"))).filter(F.col("_r") <= most)
    left, right = F.floor(F.col("k") / (F.col("n") - 1)), F.col("k") % (F.col("n") - 1)
    taken = taken.select("blk", left.alias("a"), (right + (right >= left).cast("long")).alias("b"))
    ends = {c: numbered.select("blk", F.col("r").alias(c), F.col("id").alias(x), F.col("v").alias(f"v{c}")) for c, x in (("a", "i"), ("b", "j"))}
    return taken.join(ends["a"], ["blk", "a"]).join(ends["b"], ["blk", "b"]).select("blk", "i", "j", (F.col("va") - F.col("vb")).alias("delta"))


def endpoint_coverage(df: DataFrame, block: str = "blk") -> DataFrame:
    """How many adjacent pairs each index is an end of."""
    cells = df.select(block, "idx").repartition(block).distinct().withColumn("grp", F.lit(""))
    pairs = adjacent(cells, [], block)
    return pairs.select(F.explode(F.array("lo", "hi")).alias("idx")).groupBy("idx").agg(F.count("*").alias("endpoints"))


def broken_nesting(df: DataFrame, block: str = "blk") -> DataFrame:
    """Blocks that lie in more than one group; there must be none."""
    return df.groupBy(block).agg(F.count_distinct("grp").alias("groups")).filter("groups > 1")


def assert_nested(df: DataFrame, block: str = "blk") -> DataFrame:
    """df, once no block spans two groups."""
    bad = broken_nesting(df, block).take(1)
    if bad:
        raise ValueError(f"block {bad[0][block]!r} spans {bad[0]['groups']} groups")
    return df
