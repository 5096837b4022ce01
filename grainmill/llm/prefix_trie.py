"""A trie of conversation prefixes by rolling fingerprints.

Each conversation's turns are hashed and a numpy scan gives every prefix the polynomial fingerprint of its turns, modulo 2^64. Prefixes of one
length and one fingerprint are a candidate group. Its representative is its smallest conversation; every member's last turn is
compared with the representative's, as text. If all last turns agree at all lengths, so do all prefixes: equal last turns and equal
fingerprints leave equal fingerprints of the prefixes before. Members that differ are a collision; they are split off round by round, each
round taking out those that equal the smallest of the rest, and the splits along a conversation become part of its prefixes' names.

A group is then a node. The nodes that a conversation represents are its last prefixes, without a gap: a chain that hangs on a node
of a smaller conversation. Sums over subtrees are sums over chains, doubled in reach each round (ancestors at distance 1, 2, 4, ...),
then running sums from the end of each chain. A depth of 2^k chains takes k + 1 rounds, whatever the number of turns.

Groups hold up to all conversations (the root does). Counts are partial before the shuffle, frequent groups' counts are broadcast
(HOT_GROUPS rows at most), representatives' texts are copied once for so many members that no task gets a whole hot group, and digests of
the conversations that end in a node are made by functions.digests in bounded memory.

Rows without conv_id belong to no conversation and are left out. A null turn comes first, null role and text are empty, turns of one number
are ordered by role and text, and repeated rows are turns of their own. Texts and conversations of any length are read whole; a conversation is
scanned in a stream. An empty table gives no rows, not even a root. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import ordered_digest
from .common import HOT_GROUPS, bounded_batches, frugal, join_groups, written

#: Conversations in blocks of BLOCK ids share fewer than HEADS first turns of the block's first.
BLOCK, HEADS = 20, 4
#: The factor of the polynomial, an odd number, and the bits kept of a turn's hash.
FACTOR, TURN_BITS = 0x9E3779B97F4A7C15, 64
#: A representative's turn is copied once for so many members, or once for 1 / HOT_GROUPS of all rows where that is more.
MEMBERS = 64


def _kept(df: DataFrame) -> DataFrame:
    return df.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def rebuilt(df: DataFrame) -> DataFrame:
    """conv_id, depth, role, text: the conversations after their first h turns are those of the block's first one, h by CRC-32; depth 0 is a row without text."""
    own = _kept(df)
    base, h = F.col("conv_id") - F.col("conv_id") % BLOCK, F.crc32(F.col("conv_id").cast("string")) % HEADS
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    heads = own.filter(base == F.col("conv_id")).withColumn("at", F.row_number().over(order)).filter(F.col("at") < HEADS)
    ids = own.select("conv_id").distinct()
    follow = ids.filter((h > 0) & (base != F.col("conv_id"))).select(F.col("conv_id").alias("c"), base.alias("base"), h.alias("h"))
    lent = follow.join(heads, F.col("base") == F.col("conv_id")).filter("at <= h").select(F.col("c").alias("conv_id"), F.lit(1).alias("kind"), F.col("at").cast("long").alias("turn"), "role", "text")
    rows = own.select("conv_id", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text")
    roots = ids.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("kind", F.asc_nulls_first("turn"), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(lent).unionByName(roots).withColumns({"n": F.row_number().over(order) - 1, "lent": F.sum((F.col("kind") == 1).cast("int")).over(running)})
    at = F.col("n") - F.col("lent")  # the turn's number among its conversation's own
    gone = F.when(base == F.col("conv_id"), 0).otherwise(h)
    depth = F.when(F.col("kind") == 2, F.col("n") - gone).otherwise(F.col("n"))
    return met.filter((F.col("kind") < 2) | (at > gone)).select("conv_id", depth.cast("long").alias("depth"), "role", "text")


def numbered(df: DataFrame) -> DataFrame:
    """conv_id, depth, role, text of conversations as they are."""
    own = _kept(df).withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long"))
    roots = own.filter("depth = 1").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return own.select(roots.columns).unionByName(roots)


def powers(depth: np.ndarray) -> np.ndarray:
    """FACTOR to the power of each depth, modulo 2^64, by squaring."""
    out, factor, left = np.ones(len(depth), np.uint64), FACTOR, depth.astype(np.uint64)
    while left.any():
        out[(left & np.uint64(1)) == 1] *= np.uint64(factor)
        factor = factor * factor % (1 << 64)
        left = left >> np.uint64(1)
    return out


def prefix_sums(depth: np.ndarray, turn: np.ndarray, held: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, fingerprint of the prefix before) of rows in order; held is the fingerprint of the row before the first."""
    term = turn * powers(depth)
    total = np.cumsum(term, dtype=np.uint64)
    starts = np.flatnonzero(depth == 0)
    began = np.searchsorted(starts, np.arange(len(depth)), side="right") - 1
    before = np.concatenate([np.uint64(0) - np.array([held], np.uint64), (total - term)[starts]])
    print_ = total - before[began + 1]
    return print_, print_ - term


def _scan(batches):
    import pyarrow as pa

    held = np.uint64(0)
    for batch in batches:
        if not batch.num_rows:
            continue
        depth = batch.column("depth").to_numpy(zero_copy_only=False)
        now, before = prefix_sums(depth, batch.column("_hash").to_numpy(zero_copy_only=False).view(np.uint64), held)
        held = now[-1]
        names = [n for n in batch.schema.names if n != "_hash"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(now.view(np.int64)), pa.array(before.view(np.int64))], names=[*names, "print", "before"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows with last (the conversation ends here), words, print and before: the fingerprints of the prefix with the row and without it."""
    order = Window.partitionBy("conv_id").orderBy("depth")
    h = F.when(F.col("depth") > 0, F.xxhash64("role", "text").bitwiseAND(F.lit(-1 if TURN_BITS == 64 else (1 << TURN_BITS) - 1))).otherwise(F.lit(0).cast("long"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    bounded_batches(rows)
    full = rows.select("conv_id", "depth", "role", "text", words.alias("words"), F.lead("depth").over(order).isNull().alias("last"), h.alias("_hash"))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    return full.sortWithinPartitions("conv_id", "depth").mapInArrow(frugal(_scan), f"conv_id {id_type}, depth long, role string, text string, words long, last boolean, print long, before long")


def _named(rows: DataFrame, total: int) -> DataFrame:
    """rows with rep and n: the smallest conversation of those with one depth, print and tag, and their number."""
    key = F.struct("depth", "print", "tag")
    keyed = rows.withColumn("key", key)
    groups = rows.groupBy(key.alias("key")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    return join_groups(keyed, groups, "key", "n", total, "conv_id")


def _differing(named: DataFrame, total: int) -> DataFrame:
    """conv_id, key, role, text of members whose last turn is not their representative's."""
    shared = named.filter("n > 1 and depth > 0")
    copies = F.ceil(F.col("n") / F.lit(float(max(MEMBERS, total // HOT_GROUPS)))).cast("long")
    reps = shared.filter("conv_id = rep").select(F.col("key").alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_c"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    others = shared.filter("conv_id <> rep").withColumn("_at", F.pmod(F.xxhash64("conv_id"), copies))
    met = others.join(reps, (F.col("key") == F.col("_k")) & (F.col("_at") == F.col("_c")))
    return met.filter("role <> _role or text <> _text").select("conv_id", "key", "role", "text")


def _split(differ: DataFrame) -> DataFrame | None:
    """conv_id, depth, part (1, 2, ...) of the members that differ, those with equal turns in one part; None where there are none."""
    out, part, left = None, 0, differ
    while not left.isEmpty():
        part += 1
        reps = left.groupBy(F.col("key").alias("_k")).agg(F.min(F.struct("conv_id", "role", "text")).alias("rep"))
        met = left.join(reps, F.col("key") == F.col("_k"))
        same = (F.col("role") == F.col("rep.role")) & (F.col("text") == F.col("rep.text"))
        one = written(met.filter(same).select("conv_id", F.col("key.depth").alias("depth"), F.lit(part).alias("part")))
        out = one if out is None else out.unionByName(one)
        left = written(met.filter(~same).select("conv_id", "key", "role", "text"))
    return out


def _tags(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with tag and tag_before: the splits along the conversation up to the row, and before it."""
    by = parts.groupBy(F.col("conv_id").alias("_c")).agg(F.sort_array(F.collect_list(F.struct("depth", "part"))).alias("_p"))  # turns of one conversation
    text = lambda upto: F.coalesce(F.array_join(F.transform(F.filter("_p", upto), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["part"].cast("string"))), " "), F.lit(""))
    met = rows.drop("tag", "tag_before").join(by, F.col("conv_id") == F.col("_c"), "left")
    return met.select(*rows.drop("tag", "tag_before").columns, text(lambda x: x["depth"] <= F.col("depth")).alias("tag"), text(lambda x: x["depth"] < F.col("depth")).alias("tag_before"))


def _totals(chains: DataFrame) -> DataFrame:
    """conv_id, saved, leaves of each chain with all chains below it, from conv_id, up, saved, leaves."""
    now, total = written(chains.select("conv_id", "up", "saved", "leaves")), chains.count()
    while not now.filter("up is not null").isEmpty():
        adds = now.filter("up is not null").groupBy("up").agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"), F.count("*").alias("_n"))
        adds = written(adds.join(now.select(F.col("conv_id").alias("_c"), F.col("up").alias("_up")), F.col("up") == F.col("_c")).drop("_c"))
        grown = now.join(adds.select(F.col("up").alias("_c"), "_s", "_l"), F.col("conv_id") == F.col("_c"), "left")
        grown = grown.select("conv_id", "up", (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"))
        now = written(join_groups(grown, adds.select("up", "_n", "_up"), "up", "_n", total, "conv_id").select("conv_id", F.col("_up").alias("up"), "saved", "leaves"))
    return now.select("conv_id", "saved", "leaves")


def trie(rows: DataFrame) -> DataFrame:
    """A row a node, from conv_id, depth, role, text of numbered() or rebuilt(): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prints = written(fingerprints(rows).withColumns({"tag": F.lit(""), "tag_before": F.lit("")}))
    total = max(1, prints.count())
    shared = F.col("n") > 1  # only these turns are compared
    named = written(_named(prints, total).withColumns({"role": F.when(shared, F.col("role")), "text": F.when(shared, F.col("text"))}))
    parts = _split(written(_differing(named, total)))
    if parts is not None:
        named = written(_named(_tags(prints, parts), total).drop("role", "text"))
    nodes = named.filter("conv_id = rep").select("conv_id", "depth", "key", "before", "tag_before", "n", "last", ((F.col("n") - 1) * F.col("words")).alias("own"))

    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by(F.struct("before", "tag_before"), "depth").alias("b"))
    above = F.when(F.col("top") > 0, F.struct((F.col("top") - 1).alias("depth"), F.col("b.before").alias("print"), F.col("b.tag_before").alias("tag")))
    first = written(first.select("conv_id", "top", above.alias("key")))
    hung = first.filter("key is not null").groupBy("key").agg(F.count("*").alias("_n"))
    hung = written(hung.join(nodes.select(F.col("key").alias("_k"), F.col("conv_id").alias("up")), F.col("key") == F.col("_k")).select("key", "_n", "up"))
    chains = join_groups(first, hung, "key", "_n", total, "conv_id").select("conv_id", "top", "up")
    children = F.coalesce("_n", F.lit(0)) + (~F.col("last")).cast("long")
    met = nodes.join(hung.select(F.col("key").alias("_k"), "_n"), F.col("key") == F.col("_k"), "left").withColumn("n_children", children)
    nodes = written(met.select("conv_id", "depth", "n", "own", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf")))

    sums = nodes.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    chains = written(chains.join(sums, F.col("conv_id") == F.col("_c")).drop("_c"))
    below = _totals(chains).join(chains.select(F.col("conv_id").alias("_c"), "top", "up"), F.col("conv_id") == F.col("_c")).filter("up is not null")
    below = below.groupBy(F.col("up").alias("_b"), (F.col("top") - 1).alias("_d")).agg(F.sum("saved").alias("_s"), F.sum("leaves").alias("_l"))

    ends = ordered_digest(named.filter("last").select("rep", "depth", "conv_id"), ["rep", "depth"], ["conv_id"], F.col("conv_id").cast("string"), ",")
    ends = ends.select(F.col("rep").alias("_r"), F.col("depth").alias("_e"), "digest")
    out = nodes.join(below, (F.col("conv_id") == F.col("_b")) & (F.col("depth") == F.col("_d")), "left")
    out = out.join(ends, (F.col("conv_id") == F.col("_r")) & (F.col("depth") == F.col("_e")), "left")
    out = out.join(chains.select(F.col("conv_id").alias("_c"), "top", "up"), F.col("conv_id") == F.col("_c"))
    to_end = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def subtree(own: str, hung: str) -> Column:
        return F.sum(F.col(own) + F.coalesce(hung, F.lit(0))).over(to_end).cast("long")

    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        subtree("leaf", "_l").alias("n_leaves"), subtree("own", "_s").alias("saved_tokens"), F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


SQL = r"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, conv_id - conv_id % 20 AS base,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(regexp_extract_all(conv_id::VARCHAR, '.'), lambda c: ord(c)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, _: xor(v >> 1, 3988292384 * (v & 1))), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
u AS (SELECT i.conv_id, place, role, text FROM ids i JOIN o ON o.conv_id = i.base AND place <= h
  UNION ALL SELECT i.conv_id, place, role, text FROM ids i JOIN o USING (conv_id) WHERE place > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text,
  string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM u),
p AS (SELECT conv_id, depth, sha256(path) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM d
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM p),
n AS (SELECT path, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM l GROUP BY path, depth),
k AS (SELECT above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY above),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
s AS (SELECT l.path, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved_tokens FROM m JOIN l ON l.conv_id = m.conv_id AND l.depth <= m.depth GROUP BY l.path)
SELECT m.conv_id, m.depth::BIGINT AS depth, n.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (path) LEFT JOIN n ON n.path = m.above AND m.depth > 0
"""
