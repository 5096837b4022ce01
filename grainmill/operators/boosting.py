"""Gradient boosting on histograms of binned features: leaf-wise, by levels, with dropout, and ordered.

Rows lie in blocks of packed arrays: bins of their features, target, fold, and the sum of trees so far. A pass adds gradients, weights and counts by
node, feature and bin inside each task; these small arrays are dealt by feature and summed in a stream, and each feature's best split of a node comes to the
driver. All folds of a cross-validation grow in the same passes, so these number trees times levels, whatever the number of rows or folds.

Leaf-wise growth by levels: a node's gain does not depend on others, so the driver replays best-first growth with the gains it knows and
asks for those of the nodes that it would reach, until none is unknown. Missing values have a bin of their own and go to the side with the higher gain.

A block holds each different row of bins once, and which of them each row has: trees are descended by different rows of bins, whose values and sums
each row then looks up. Names of rows and groups stay in a table that passes do not read.

Sums of trees are written with the blocks each EVERY trees; younger trees, and older ones that dropout takes out or rescales, are applied on the way. Ordered boosting deals rows to segments by hash: a row's gradient
comes from leaf values of earlier segments only, so its own target never reaches it; held-out rows and the model use all segments.

Bin edges are quantiles of the features of all rows; targets of held-out rows are not used anywhere.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..sources.files import stored

BLOCK_ROWS, EVERY = 32_768, 8


@dataclass(frozen=True)
class Boosting:
    """trees, learning rate, most leaves and levels of a tree, least rows and hessian of a leaf, L2 penalty and least gain, bins of a feature, shares of
    features and rows a tree, share of trees dropped (dart), segments (ordered), one split a level (symmetric)."""

    trees: int = 20
    rate: float = 0.1
    leaves: int = 31
    depth: int = 6
    least_rows: int = 20
    least_hessian: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    bins: int = 64
    columns: float = 1.0
    rows: float = 1.0
    drop: float = 0.0
    segments: int = 0
    symmetric: bool = False
    seed: str = "0"


#: The named learners. Those of the outside libraries are theirs in kind: growth, regularisation and sampling, not their random numbers.
LEARNERS = {
    "hgb": Boosting(rate=0.1, leaves=31, l2=1.0),
    "lgbm": Boosting(rate=0.1, leaves=31, columns=0.6, rows=0.8),
    "lgbm_dart": Boosting(rate=0.1, leaves=31, rows=0.8, drop=0.1),
    "xgb": Boosting(rate=0.1, leaves=1 << 6, depth=6, least_rows=1, least_hessian=3.0, columns=0.6, rows=0.8),
    "catboost": Boosting(rate=0.1, leaves=1 << 5, depth=5, least_rows=1, l2=3.0, segments=8, symmetric=True),
}


@dataclass
class Tree:
    """Arrays by node: feature (-1 in a leaf), bin of the split, whether missing goes left, children, leaf number; value by leaf and segment (the last column is that of all)."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    scale: float = 1.0

    def leaves(self, bins: np.ndarray, missing: int) -> np.ndarray:
        """The leaf number, or in a growing tree the node without children, of each row of bins."""
        return self.leaf[self.nodes(bins, missing)]

    def nodes(self, bins: np.ndarray, missing: int) -> np.ndarray:
        at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = bins[row, np.where(inner, f, 0)]
            to_left = np.where(b == missing, self.missing_left[at], b <= self.bin[at])
            at = np.where(inner, np.where(to_left, self.left[at], self.right[at]), at)


@dataclass
class _Node:
    g: float
    h: float
    n: int
    depth: int
    split: dict | None = None
    known: bool = False
    children: tuple[int, int] | None = None


class _Growth:
    """A tree of one fold while it grows."""

    def __init__(self, p: Boosting):
        self.p, self.nodes = p, [_Node(0.0, 0.0, 0, 0)]

    def replay(self) -> tuple[list[int], set[int]]:
        """(nodes that best-first growth would reach and whose gain is unknown, nodes that it splits)."""
        wanted, parted, leaves = [], set(), 1
        heap = [(-np.inf, 0)]
        while heap and leaves < self.p.leaves:
            _, k = heapq.heappop(heap)
            node = self.nodes[k]
            if not node.known:
                wanted.append(k)
            elif node.split:
                parted.add(k)
                for c in node.children:
                    child = self.nodes[c]
                    if child.depth < self.p.depth and (not child.known or child.split):
                        heapq.heappush(heap, (-child.split["gain"] if child.known else -np.inf, c))
            else:
                continue
            leaves += 1
        return wanted, parted

    def learn(self, k: int, split: dict | None) -> None:
        node = self.nodes[k]
        node.known, node.split = True, split
        if split:
            node.g, node.h, node.n = split["g"], split["h"], split["n"]
            left = _Node(split["gl"], split["hl"], split["nl"], node.depth + 1)
            right = _Node(node.g - left.g, node.h - left.h, node.n - left.n, node.depth + 1)
            for child in (left, right):
                child.known = child.n < 2 * self.p.least_rows
            node.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [left, right]

    def tree(self, parted: set[int] | None = None) -> Tree:
        inner = [node.split if node.split and (parted is None or k in parted) else None for k, node in enumerate(self.nodes)]
        get = lambda name, none, kind: np.array([s[name] if s else none for s in inner], kind)
        kids = np.array([node.children or (0, 0) for node in self.nodes])
        leaf, reached, todo = np.zeros(len(self.nodes), np.int64), [], [0]
        while todo:
            k = todo.pop()
            if inner[k]:
                todo += self.nodes[k].children
            else:
                reached.append(k)
        leaf[reached] = np.arange(len(reached))
        value = np.array([[-self.p.rate * self.nodes[k].g / (self.nodes[k].h + self.p.l2)] if self.nodes[k].h + self.p.l2 else [0.0] for k in reached])
        return Tree(get("feature", -1, np.int64), get("bin", 0, np.int64), get("missing_left", False, bool), kids[:, 0], kids[:, 1], leaf, value)


# ---- blocks


def edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Upper edges of each feature's bins but the last: at most bins - 1 distinct quantiles."""
    levels = F.array(*(F.lit((k + 1) / bins) for k in range(bins - 1)))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*(F.percentile_approx(number(c), levels, F.lit(10_000)).alias(c) for c in features)).first()
    return [sorted(set(row[c] or [])) for c in features]


def _binned(x, cuts: list[float], missing: int) -> np.ndarray:
    v = np.asarray(x.to_numpy(zero_copy_only=False), dtype=float)
    return np.where(np.isnan(v), missing, np.searchsorted(cuts, v, side="left")).astype(np.uint16)


def _different(bins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the different rows of bins, which one each row is); rows are numbers in base width where these fit."""
    if width ** bins.shape[1] >= 1 << 62:
        return np.unique(bins, axis=0, return_inverse=True)
    code = bins.astype(np.int64) @ (width ** np.arange(bins.shape[1], dtype=np.int64))
    _, first, which = np.unique(code, return_index=True, return_inverse=True)
    return bins[first], which


def _blocks(df: DataFrame, features: list[str], cuts: list[list[float]], p: Boosting, folds: int, base: list[float], weight: str | None) -> DataFrame:
    """ids and groups of a block's rows, their arrays, and total: the sum of trees of each fold's model (base at first)."""
    missing, segments, hashed = p.bins, max(1, p.segments), hash32(F.concat_ws("|", F.lit(p.seed), F.col("row_id").cast("string")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                col = lambda name, kind: np.asarray(batch.column(name).to_numpy(zero_copy_only=False), dtype=kind)  # noqa: E731, B023
                bins = np.stack([_binned(batch.column(f"_x{k}"), cuts[k], missing) for k in range(len(features))], axis=1)
                bins, which = _different(bins, missing + 1)
                total = np.tile(np.array(base), (batch.num_rows, 1))
                arrays = [bins, which.ravel().astype("i4"), col("y", "f8"), col("_w", "f8"), col("fold", "i4"), col("_hash", "i8"), (col("_hash", "i8") % segments).astype("i4"), total]
                ids, grp = (pa.array([batch.column(c)], pa.list_(pa.string())) for c in ("row_id", "grp"))
                yield pa.RecordBatch.from_arrays([ids, grp, *(pa.array([np.ascontiguousarray(a).tobytes()]) for a in arrays)], names=["ids", "grp", *ARRAYS])

    x = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    slim = df.select(F.col("row_id").cast("string").alias("row_id"), F.col("grp").cast("string").alias("grp"), F.col("y").cast("double").alias("y"), w.alias("_w"), "fold", hashed.cast("long").alias("_hash"), *x)
    return slim.mapInArrow(run, "ids array<string>, grp array<string>, " + ", ".join(f"{a} binary" for a in ARRAYS))


ARRAYS = ("bins", "which", "y", "w", "fold", "hash", "segment", "total")


class _Block:
    """A block's arrays, with total brought up to date by the trees that are not yet written and those rescaled since.

    bins are the different rows of bins and which the one of each row; trees' values are added up by the former (and segment), then looked up."""

    def __init__(self, row: dict, features: int, folds: int, state: _State):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
        self.which, self.y, self.w, self.fold, self.hash, self.segment = read("which", "i4"), read("y", "f8"), read("w", "f8"), read("fold", "i4"), read("hash", "i8"), read("segment", "i4")
        self.bins, self.missing = read("bins", np.uint16).reshape(-1, features), state.p.bins
        self.total = read("total", "f8").reshape(len(self.y), folds).copy()
        for k in range(folds):
            parts = [(t, trees[k].scale - (state.scales[t][k] if t < state.written else 0.0)) for t, trees in enumerate(state.trees)]
            self.total[:, k] += self._sum(state, k, [(t, by) for t, by in parts if by])

    def _sum(self, state: _State, k: int, parts: list[tuple[int, float]]) -> np.ndarray | float:
        """What some trees of fold k's model, each times a number, give every row."""
        if not parts:
            return 0.0
        values = 0.0
        for t, by in parts:
            tree = state.trees[t][k]
            values = values + tree.value[tree.leaves(self.bins, self.missing)] * by
        if values.shape[1] == 1:
            return values[:, 0][self.which]
        last = values.shape[1] - 1
        return values.ravel()[self.which * np.int64(last + 1) + np.where(self.fold == k, last, self.segment)]

    def gradient(self, state: _State, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, weight) of the squared error for fold k's next tree; 0 for held-out rows and rows not drawn."""
        p = state.p
        now = self.total[:, k] - self._sum(state, k, [(t, state.trees[t][k].scale) for t in state.dropped])
        w = self.w * (self.fold != k)
        if p.rows < 1:
            mixed = (self.hash * 2654435761 + len(state.trees) * 40503) % 1_000_003
            w = w * (mixed < p.rows * 1_000_003)
        return (now - self.y) * w, w


@dataclass
class _State:
    """What tasks need to bring a block up to date: all trees by number and fold, how many are written, scales at that time, trees dropped now."""

    p: Boosting
    trees: list[list[Tree]]
    written: int
    scales: list[list[float]]
    dropped: tuple[int, ...] = ()


# ---- passes


def _histograms(blocks: DataFrame, features: int, folds: int, state: _State, growing: list[Tree], slots: list[dict[int, int]], columns: list[int]) -> DataFrame:
    """fold, feature, sums: each task's gradients, weights and numbers of rows by slot and bin; slot numbers the nodes asked for."""
    width = state.p.bins + 1

    def run(batches):
        import pyarrow as pa

        sums = {(k, f): np.zeros((3, len(slots[k]) * width)) for k in range(folds) if slots[k] for f in columns}
        for batch in batches:
            for row in batch.to_struct_array():
                block = _Block(row, features, folds, state)
                for k in range(folds):
                    if not slots[k]:
                        continue
                    g, w = block.gradient(state, k)
                    of = np.full(len(growing[k].feature), -1)
                    of[list(slots[k])] = list(slots[k].values())
                    slot = of[growing[k].nodes(block.bins, block.missing)]
                    inside = np.flatnonzero(slot >= 0)
                    by = [np.bincount(block.which, weight, len(slot))[inside] for weight in (g, w, w > 0)]
                    for f in columns:
                        key = slot[inside] * width + block.bins[inside, f]
                        for at, weight in enumerate(by):
                            sums[k, f][at] += np.bincount(key, weight, len(slots[k]) * width)
        if sums:
            fold, feature = (pa.array([key[j] for key in sums], pa.int32()) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([fold, feature, pa.array([x.tobytes() for x in sums.values()])], names=["fold", "feature", "sums"])

    return blocks.mapInArrow(run, "fold int, feature int, sums binary")


def splits(sums: np.ndarray, p: Boosting) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, whether missing goes left, sums of the left side) by slot and bin, of sums by gradient, weight and number, slot, and bin; no split has no gain."""
    missing, known = sums[:, :, -1:], sums[:, :, :-1]
    whole = sums.sum(2, keepdims=True)

    def score(x: np.ndarray) -> np.ndarray:
        return np.divide(x[0] ** 2, x[1] + p.l2, out=np.zeros_like(x[0]), where=x[1] + p.l2 > 0)

    gains, lefts = [], []
    for left in (known.cumsum(2), known.cumsum(2) + missing):
        right = whole - left
        fits = np.minimum(left[2], right[2]) >= max(1, p.least_rows)
        fits &= np.minimum(left[1], right[1]) >= p.least_hessian
        gains.append(np.where(fits, np.round(score(left) + score(right) - score(whole), 9), -np.inf))
        lefts.append(left)
    to_left = gains[1] > gains[0]
    return np.maximum(*gains), to_left, np.where(to_left, lefts[1], lefts[0])


FOUND = "fold int, feature int, slot int, bin int, missing_left boolean, total double, gain double, " + ", ".join(f"{x} double" for x in ("gl", "hl", "nl", "g", "h", "n"))


def _best(sums: DataFrame, p: Boosting) -> list[dict]:
    """The best split of each fold and slot above gamma, ties to the first feature and bin.

    A task adds up the features that are dealt to it one row at a time; a row for each fold, slot and feature comes to the driver, whatever the data."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for fold, feature, part in zip(*batch.columns, strict=True):
                key, one = (fold.as_py(), feature.as_py()), np.frombuffer(part.as_buffer(), "f8")
                held[key] = held[key] + one if key in held else one
        rows = []
        for (fold, feature), x in held.items():
            x = x.reshape(3, -1, p.bins + 1)
            gain, to_left, left = splits(x, p)
            whole, slots = x.sum(2), range(gain.shape[0])
            total = np.where(np.isfinite(gain), gain, 0).sum(0)
            at = np.full(gain.shape[0], total.argmax()) if p.symmetric else gain.argmax(1)
            rows += [(fold, feature, i, b, bool(to_left[i, b]), float(total[b]), float(gain[i, b]), *left[:, i, b].tolist(), *whole[:, i].tolist()) for i, b in zip(slots, at.tolist(), strict=True)]
        if rows:
            kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    out: dict[tuple[int, int], dict] = {}
    found = sums.repartition("fold", "feature").mapInArrow(run, FOUND).toArrow().to_pylist()
    by = "total" if p.symmetric else "gain"
    for x in sorted(found, key=lambda x: (-x[by], x["feature"])):
        out.setdefault((x["fold"], x["slot"]), x)
    return [x for x in out.values() if x[by] > p.gamma and np.isfinite(x["gain"])]


def _by_segment(blocks: DataFrame, features: int, folds: int, state: _State, grown: list[Tree]) -> list[np.ndarray]:
    """Leaf values of each fold's new tree by segment: each from the segments before it, the last from all."""
    segments, p = state.p.segments, state.p
    sizes = [len(t.value) for t in grown]

    def run(batches):
        import pyarrow as pa

        sums = [np.zeros((2, n * segments)) for n in sizes]
        for batch in batches:
            for row in batch.to_struct_array():
                block = _Block(row, features, folds, state)
                for k in range(folds):
                    g, w = block.gradient(state, k)
                    key = grown[k].leaves(block.bins, block.missing)[block.which] * segments + block.segment
                    for at, weight in enumerate((g, w)):
                        sums[k][at] += np.bincount(key, weight, sizes[k] * segments)
        fold = np.concatenate([np.full(n * segments, k) for k, n in enumerate(sizes)])
        at = np.concatenate([np.arange(n * segments) for n in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(at, pa.int32()), *(pa.array(np.concatenate([s[j] for s in sums])) for j in (0, 1))], names=["fold", "at", "g", "h"])

    found = blocks.mapInArrow(run, "fold int, at int, g double, h double").groupBy("fold", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    out = []
    for k, n in enumerate(sizes):
        sums = np.zeros((2, n * segments))
        for r in found:
            if r["fold"] == k:
                sums[:, r["at"]] = r["g"], r["h"]
        g, h = (np.concatenate([np.zeros((n, 1)), s.reshape(n, segments).cumsum(1)], axis=1) for s in sums)
        out.append(np.divide(-p.rate * g, h + p.l2, out=np.zeros_like(g), where=h + p.l2 > 0))
    return out


def _rewritten(blocks: DataFrame, features: int, folds: int, state: _State) -> DataFrame:
    """blocks with up-to-date totals."""
    names = blocks.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(batch.to_struct_array()):
                block = _Block(row, features, folds, state)
                yield pa.RecordBatch.from_arrays([pa.array([block.total.tobytes()], pa.binary()) if n == "total" else batch.column(n).slice(i, 1) for n in names], names=names)

    return stored(blocks.mapInArrow(run, blocks.schema))


def _drawn(p: Boosting, number: int, of: int, share: float, what: str) -> list[int]:
    """A share of the numbers below `of`, one at least, by hash."""
    order = sorted(range(of), key=lambda k: hashlib.md5(f"{p.seed}|{what}|{number}|{k}".encode()).hexdigest())
    return sorted(order[: max(1, round(share * of))])


@dataclass
class Model:
    """Trees of each fold's model, with what it takes to bin features."""

    p: Boosting
    features: list[str]
    cuts: list[list[float]]
    base: list[float]
    trees: list[list[Tree]]

    def predict(self, df: DataFrame, fold: int = 0, name: str = "prediction") -> DataFrame:
        """df with the model's prediction."""
        from pyspark.sql.types import DoubleType, StructType

        cuts, missing, base, trees = self.cuts, self.p.bins, self.base[fold], [t[fold] for t in self.trees]
        columns, features = df.columns, len(self.features)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                bins = np.stack([_binned(batch.column(len(columns) + k), cuts[k], missing) for k in range(features)], axis=1)
                out = np.full(batch.num_rows, base)
                for t in trees:
                    out += t.value[t.leaves(bins, missing), -1] * t.scale
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(out)], names=[*columns, name])

        x = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(self.features)]
        return df.select("*", *x).mapInArrow(run, StructType([*df.schema.fields]).add(name, DoubleType()))


def boost(dealt: DataFrame, features: list[str], p: Boosting, folds: int = 1, weight: str | None = None) -> tuple[Model, DataFrame]:
    """(model, row_id, y, grp, fold, oof) from row_id, y, grp, fold and features; a fold's model sees no row of it, and fold -1 belongs to all models."""
    dealt = stored(dealt)
    cuts = edges(dealt, features, p.bins)
    w = F.col(weight) if weight else F.lit(1.0)
    sums = {r["fold"]: (r["s"], r["w"]) for r in dealt.groupBy("fold").agg(F.sum(F.col("y") * w).alias("s"), F.sum(w).alias("w")).collect()}
    base = []
    for k in range(folds):
        own = [v for f, v in sums.items() if f != k]
        base.append(sum(s for s, _ in own) / sum(n for _, n in own) if sum(n for _, n in own) else 0.0)
    per = dealt.sparkSession.conf
    held = per.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    per.set("spark.sql.execution.arrow.maxRecordsPerBatch", BLOCK_ROWS)
    try:
        every = stored(_blocks(dealt, features, cuts, p, folds, base, weight))
    finally:
        per.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    blocks, count = every.select(*ARRAYS), len(features)
    state = _State(p, [], 0, [])
    for number in range(p.trees):
        columns = _drawn(p, number, len(features), p.columns, "columns")
        dropped = tuple(t for t in range(number) if int(hashlib.md5(f"{p.seed}|drop|{number}|{t}".encode()).hexdigest()[:8], 16) < p.drop * (1 << 32)) if p.drop else ()
        state = replace(state, dropped=dropped)
        growth = [_Growth(p) for _ in range(folds)]
        while True:
            asked = [g.replay()[0] for g in growth]
            if not any(asked):
                break
            slots = [{k: s for s, k in enumerate(a)} for a in asked]
            found = {(x["fold"], x["slot"]): x for x in _best(_histograms(blocks, len(features), folds, state, [g.tree() for g in growth], slots, columns), p)}
            for k, g in enumerate(growth):
                for node, slot in slots[k].items():
                    g.learn(node, found.get((k, slot)))
        grown = [g.tree(g.replay()[1]) for g in growth]
        if p.segments:
            grown = [replace(t, value=v) for t, v in zip(grown, _by_segment(blocks, len(features), folds, state, grown), strict=True)]
        if dropped:
            for t in dropped:
                for tree in state.trees[t]:
                    tree.scale *= len(dropped) / (len(dropped) + 1)
            for tree in grown:
                tree.scale = 1 / (len(dropped) + 1)
        state.trees.append(grown)
        if len(state.trees) - state.written == EVERY and number < p.trees - 1:
            blocks = _rewritten(blocks, len(features), folds, replace(state, dropped=()))
            state = replace(state, written=len(state.trees), scales=[[t.scale for t in trees] for trees in state.trees])

    state = replace(state, written=0, scales=[], dropped=())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_struct_array():
                block = _Block(row, count, folds, state)
                oof = block.total[np.arange(len(block.y)), np.maximum(block.fold, 0)]
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(block.y), row["grp"].values, pa.array(block.fold), pa.array(oof)], names=["row_id", "y", "grp", "fold", "oof"])

    return Model(p, features, cuts, base, state.trees), every.mapInArrow(run, "row_id string, y double, grp string, fold int, oof double")


def fit(df: DataFrame, features: list[str], p: Boosting, weight: str | None = None) -> Model:
    """A model of all rows of df (row_id, y, grp and features)."""
    return boost(df.withColumn("fold", F.lit(-1)), features, p, 1, weight)[0]


# ---- categories


def ordered_statistic(df: DataFrame, category: str, y: str = "y", row: str = "row_id", seed: str = "0", prior: float = 1.0, name: str = "encoded") -> DataFrame:
    """df with each row's category as (sum of y of the category's rows before it + prior * mean of y) / (their number + prior), rows in the order of a hash.

    No row's own target is in its code. Rows are summed by category and leading bits of the hash; what lies before such a bin is a running sum over
    a category's bins (BINS at most), and only rows of one bin and category are ordered: a frequent category is spread over its bins. Null is a category."""
    h, key = hash32(F.concat_ws("|", F.lit(seed), F.col(row).cast("string"))), F.coalesce(F.col(category).cast("string"), F.lit("\0null"))
    binned = df.withColumns({"_c": key, "_h": h, "_bin": F.shiftright(h, 32 - BIN_BITS)})
    sums = binned.groupBy("_c", "_bin").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    before = Window.partitionBy("_c").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("_c", "_bin", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    mean = df.agg(F.avg(y).alias("_mean"))
    inside = Window.partitionBy("_c", "_bin").orderBy("_h", row).rowsBetween(Window.unboundedPreceding, -1)
    met = binned.join(start, ["_c", "_bin"]).crossJoin(F.broadcast(mean))  # one row
    total, number = F.col("_s") + F.coalesce(F.sum(y).over(inside), F.lit(0.0)), F.col("_n") + F.count(y).over(inside)
    return met.select(*df.columns, ((total + F.lit(float(prior)) * F.col("_mean")) / (number + F.lit(float(prior)))).alias(name))


BIN_BITS = 12
