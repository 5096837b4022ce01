"""Connected components of a table of links, by contraction.

A round reads the links where they stand, in parts of at most PART rows. A part is contracted to a forest: each of its nodes points to the smallest node that
the part connects it with. A node with several such roots, of several parts, keeps the smallest and links the others to it; these links
go on to the next round, with the pointers of nodes that are roots themselves, until one part holds all. Labels follow the
pointers back, last round first. Links are not dealt by node, so one with many links lies in as many parts as they do, and no task
holds more than PART links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, written

PART = 1 << 18
_EDGE = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each is connected with) of links a[k]-b[k], by repeated halving of paths."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        low, high = np.minimum(ru, rv), np.maximum(ru, rv)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def part(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        nodes, roots = forest(np.concatenate(a), np.concatenate(b))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], schema=_EDGE)

    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += batch.num_rows
        while held >= PART:
            x, y = np.concatenate(a), np.concatenate(b)
            yield part([x[:PART]], [y[:PART]])
            a, b, held = [x[PART:]], [y[PART:]], held - PART
    if held:
        yield part(a, b)


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes with a link (a, b) to another, except those that are a component's smallest."""
    now = links.select("a", "b").filter("a <> b")
    rounds: list[DataFrame] = []
    n = now.count()
    while n:
        whole = n <= PART
        found = (now.coalesce(1) if whole else now).mapInArrow(frugal(_contract), "node long, root long")
        rounds.append(written(found.groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", F.array_min("roots").alias("root"), "roots")))
        if whole:
            break
        several = rounds[-1].filter(F.size("roots") > 1).select(F.col("root").alias("a"), F.explode("roots").alias("b")).filter("a <> b")
        inner = rounds[-1].join(rounds[-1].select(F.explode("roots").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b"))
        now = written(several.unionByName(inner).distinct())
        n = now.count()
    if not rounds:
        return links.sparkSession.createDataFrame([], "node long, component long")
    out = rounds.pop().select("node", F.col("root").alias("component"))
    while rounds:
        before = rounds.pop().select("node", "root")
        later = out.select(F.col("node").alias("root"), F.col("component").alias("up"))
        moved = before.join(later, "root", "left").select("node", F.coalesce("up", "root").alias("component"))
        out = written(moved.unionByName(out.join(before.select("node"), "node", "left_anti")))
    return out
