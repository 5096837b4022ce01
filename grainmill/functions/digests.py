"""SHA-256 of each group's items in order, in bounded memory whatever the size of a group.

Rows are sorted by ranges of group and order, so a large group lies in many tasks; each task joins the items of a group in a batch
to one chunk. A group's chunks, in order, then run through one hash in one task, which holds a chunk at a time: the digest of
a text is defined from its front to its end, so this last step cannot be divided, but it reads one row for each batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _chunks(sep: str, by: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(name) for name in by]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = True
            for key in keys:
                a, b = key[1:], key[:-1]
                differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
                new[1:] |= differs
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], batch.num_rows)
            offsets = pa.array(np.append(starts, batch.num_rows), pa.int32())
            joined = pc.binary_join(pa.ListArray.from_arrays(offsets, batch.column("_item").cast(pa.string())), sep).cast(pa.binary())
            first = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [*(k.take(first) for k in keys), pa.array(np.full(len(starts), part), pa.int32()), pa.array(np.arange(seq, seq + len(starts))), pa.array(ends - starts), joined],
                names=[*by, "_part", "_seq", "_n", "_chunk"],
            )
            seq += len(starts)

    return run


def _hashed(sep: str, by: list[str]):
    def run(batches):
        import pyarrow as pa

        held, state, n, schema = None, None, 0, None

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(held, schema, strict=True)), pa.array([n]), pa.array([state.hexdigest()])], names=[*by, "n", "digest"])

        for batch in batches:
            schema = [batch.schema.field(name).type for name in by]
            for *key, count, chunk in zip(*(batch.column(name) for name in (*by, "_n", "_chunk")), strict=True):
                key = [k.as_py() for k in key]
                if key != held:
                    if held is not None:
                        yield out()
                    held, state, n = key, hashlib.sha256(), 0
                elif n:
                    state.update(sep.encode())
                state.update(chunk.as_buffer())
                n += count.as_py()
        if held is not None:
            yield out()

    return run


def ordered_digest(df: DataFrame, by: list[str], order: list[str], item: Column, sep: str) -> DataFrame:
    """by, n, digest: the number of rows of each group, and the lowercase hex SHA-256 of its items, never null, joined by sep in the order given (nulls first)."""
    types = ", ".join(f"{name} {df.schema[name].dataType.simpleString()}" for name in by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(*by, *(F.col(o).alias(f"_o{k}") for k, o in enumerate(order)), item.alias("_item"))
    keys = [*by, *(f"_o{k}" for k in range(len(order)))]
    dealt = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(*by, "_item")
    chunks = dealt.mapInArrow(_chunks(sep, by), f"{types}, _part int, _seq long, _n long, _chunk binary")
    dealt = chunks.repartition(*by).sortWithinPartitions(*by, "_part", "_seq")
    return dealt.mapInArrow(_hashed(sep, by), f"{types}, n long, digest string")
