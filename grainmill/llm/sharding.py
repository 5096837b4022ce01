"""Consistent-hash ring with virtual nodes and bounded loads, holding the law "rows": shard counts differ by one at most.

The ring has CELLS cells. Each shard has VNODES virtual nodes, at cells given by a hash of its number; a cell belongs
to the next virtual node clockwise. A shard takes rows / shards rows, rounded up for the first (rows mod shards)
shards. Rows of a cell are ranked by hash; what a full shard cannot take continues clockwise to the next virtual node
whose shard has room. Only CELLS counts, whatever the input, come to the driver, which returns for each cell the
ranges of ranks that go to each shard.

Rows of one doc_id, size and CRC are one entry with a count, summed before it is shuffled. A cell's entries are ranked by running sums, and
an entry's rows are laid out again from its ranges in pieces of PIECE, so that a doc_id that is null or repeated in any share of the rows fills no
task. A row's cell comes from its doc_id and CRC.

Null text has size 16 and CRC 0. Ties in the order of a cell are rows that are equal in all columns of the result. Very long texts count by their
size and CRC as others do. An empty table gives no rows. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CELL_BITS = 16
CELLS = 1 << CELL_BITS
VNODES = 64
PIECE = 1 << 16


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes by cell; of two at one cell the lower shard's stays."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest(), "big") % cells, s)
    return sorted(at.items())


def assign(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank) from the rows of each cell."""
    nodes = ring(shards, vnodes, cells)
    rows = sum(counts.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    slot = [0] * shards
    following = list(range(1, len(nodes))) + [0]  # of each node, the next that may have room

    def with_room(k: int) -> int:
        path = []
        while not room[nodes[k][1]]:
            path.append(k)
            k = following[k]
        for p in path:
            following[p] = k
        return k

    out, late, node = [], [], 0
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        k = node % len(nodes)
        s = nodes[k][1]
        take = min(counts[cell], room[s])
        if take:
            out.append((cell, 0, take, s, slot[s]))
            room[s] -= take
            slot[s] += take
        if take < counts[cell]:
            late.append((cell, take, counts[cell], k))
    for cell, begin, end, k in late:
        while begin < end:
            k = with_room(k)
            s = nodes[k][1]
            take = min(end - begin, room[s])
            out.append((cell, begin, begin + take, s, slot[s]))
            room[s] -= take
            slot[s] += take
            begin += take
    return out


def ring_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    h = F.xxhash64("doc_id", "text_crc32")
    entries = slim.groupBy("doc_id", "text_crc32", "size").agg(F.count("*").alias("rows"))
    entries = written(entries.withColumn("h", h).withColumn("cell", F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int")))
    counts = {r["cell"]: r["rows"] for r in entries.groupBy("cell").agg(F.sum("rows").alias("rows")).collect()}  # CELLS rows at most
    ranges = df.sparkSession.createDataFrame(assign(counts, shards) or [(0, 0, 0, 0, 0)], "range_cell int, first long, past long, shard int, slot0 long")
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = entries.withColumn("to", F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from", F.col("to") - F.col("rows"))
    met = ranked.join(F.broadcast(ranges), (F.col("cell") == F.col("range_cell")) & (F.col("from") < F.col("past")) & (F.col("to") > F.col("first")))
    low, high = F.greatest("from", "first"), F.least("to", "past")
    parts = met.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + low - F.col("first")).alias("slot"), (high - low).alias("n"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long")))
    pieces = parts.withColumn("at", starts).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("at")).alias("slot"), F.least(F.col("n") - F.col("at"), F.lit(PIECE)).alias("n"))
    laid = pieces.repartition("doc_id", "slot").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
