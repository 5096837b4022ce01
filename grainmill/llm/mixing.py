"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and the leading bits of a hash of doc_id and text. Per source the bucket in which the running sum
passes the budget is the boundary; only its rows are summed again by the next bits, until the hash is used up. Then a
row is in when its hash is below its source's threshold: no sort of rows, and a larger budget keeps what a smaller one took.

Sources in code-point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all tokens; a target stops at
twice its source's tokens and the excess is shared again by weight. A document is taken once for each whole multiple of
its source that the target holds, and once more below the threshold; at the threshold it goes to the nearer side.

Sources stay a table: their order comes from a sort by ranges, the level of the water from sums over that table, thresholds
from joins. Rows meet their source's numbers by broadcast for the most frequent sources (HOT_GROUPS at most) and by a shuffle of
slim rows for others. Nothing that grows with the sources comes to the driver.

Null or empty text has size 0, and a null source is a source. Rows equal in doc_id and text have one hash and are taken together; rows that share
a doc_id, null included, and differ in text do not. Ties in the hash are taken together, too. Very long texts count by their words as others do. An
empty table gives no rows. Other columns, of whatever name, are ignored by mix() and carried along by mixed_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
HASH_BITS, LEVEL_BITS = 60, 12
RANGES = 64  # parts of the sort of sources


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's target tokens from (source, tokens); what goals() does, for a few sources."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    left, budget, out = dict(order), share * sum(n for _, n in order), {}
    while left:
        unit = budget / sum(weight[s] for s in left)
        over = [s for s, n in left.items() if weight[s] * unit > most * n]
        if not over:
            return out | {s: weight[s] * unit for s in left}
        for s in over:
            out[s] = float(most * left.pop(s))
            budget -= out[s]
    return out


def place(id_: Column, text: Column) -> Column:
    """The document's place in its source: HASH_BITS bits of the MD5 of its id and text."""
    named = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A name of the source that is never null; names of null come last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def goals(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, n, rows, target, whole (multiples of the source that the target holds), need (tokens beyond them) of each source, from key, n, rows."""
    dealt = written(totals.repartitionByRange(RANGES, "key").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("_n"))  # RANGES rows at most
    before = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = written(dealt.join(F.broadcast(before), F.col("part") == F.col("_part")).withColumn("w", weight).select("key", "n", "rows", "w"))
    top = most * F.col("n")
    level = 0.0  # tokens a unit of weight; sources whose top is below it are full
    while True:
        full = F.col("w") * F.lit(level) > top
        sums = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not sums["w"] or (higher := (share * sums["n"] - sums["full"]) / sums["w"]) <= level:
            break
        level = higher
    out = ranked.withColumn("target", F.least(F.col("w") * F.lit(level), top.cast("double")))
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("int")
    return out.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("n")).drop("w")


def thresholds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, key, size and place h of every row; of each source key, rows, source_size, target, whole multiple and largest place that is taken once more)."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    slim = written(df.select(F.col(id_col).alias("doc_id"), source.alias("source"), source_key(source).alias("key"), size.alias("size"), place(F.col(id_col), F.col(text_col)).alias("h")))
    goal = written(goals(slim.groupBy("key").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))))
    total = goal.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
    edges = goal.filter("need > 0").select("key", "need", "rows")
    inside, past = slim.select("key", "size", "h"), []
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        wide = HASH_BITS - used
        sums = inside.groupBy("key", F.shiftright("h", wide).alias("bucket")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("to", F.sum("n").over(Window.partitionBy("key").orderBy("bucket")))  # a source has 2 ** LEVEL_BITS buckets at most
        met = run.join(edges, "key")
        found = met.groupBy("key", "rows", "need").agg(F.min(F.when(F.col("to") >= F.col("need"), F.struct("bucket", "n", "to"))).alias("x"), F.max("bucket").alias("last"))
        found = written(found.select("key", "rows", "need", "last", F.col("x.bucket").alias("edge"), F.col("x.n").alias("n"), F.col("x.to").alias("to")))
        # Where no bucket reaches what is needed, which rounding alone can cause, the last one fits as a whole.
        past.append(found.filter("edge is null").select("key", (F.shiftleft(F.col("last") + 1, wide) - 1).alias("past")))
        held = found.filter("edge is not null")
        before = F.col("to") - F.col("n")
        if not wide:
            past.append(held.select("key", F.when(F.col("to") + before < 2 * F.col("need"), F.col("edge")).otherwise(F.col("edge") - 1).alias("past")))
            break
        marked = join_groups(inside, held.select("key", "edge", "rows"), "key", "rows", max(1, total), "h") if used == LEVEL_BITS else inside.join(held.select("key", "edge"), "key")
        inside = written(marked.filter(F.shiftright("h", wide) == F.col("edge")).select("key", "size", "h"))
        edges = held.select("key", (F.col("need") - before).alias("need"), "rows")
    bound = past[0]
    for p in past[1:]:
        bound = bound.unionByName(p)
    return slim, written(goal.join(bound, "key", "left").select("key", "rows", F.col("n").alias("source_size"), "target", "whole", F.coalesce("past", F.lit(-1).cast("long")).alias("past")))


def _copies(h: Column) -> Column:
    return F.col("whole") + (h <= F.col("past")).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken (tokens, repeats counted), copies, source of every row."""
    slim, table = thresholds(df, id_col, text_col, source_col)
    copies = _copies(F.col("h"))
    met = join_groups(slim, table, "key", "rows", max(1, slim.count()), "h")
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each time that its document is taken. Texts of frequent sources meet thresholds by broadcast, so they are not shuffled."""
    slim, table = thresholds(docs, id_col, text_col, source_col)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), source_key(F.col(source_col)).alias("key"), place(F.col(id_col), F.col(text_col)).alias("h"))
    taken = join_groups(keyed, table, "key", "rows", max(1, slim.count()), "h").withColumn("_times", _copies(F.col("h"))).filter("_times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
r AS (SELECT *, 2.0 * n / w AS ratio, row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS k FROM s),
lev AS (
  SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM r),
water AS (SELECT min_by(unit, k) AS unit FROM lev WHERE unit <= ratio),
t AS (SELECT source, n, least(w * water.unit, 2.0 * n) AS target FROM r, water),
c AS (
  SELECT d.doc_id, d.size, t.n AS source_size, t.target,
         CASE WHEN t.n = 0 THEN 0 ELSE floor(t.target / t.n) END AS whole,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - own < 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
