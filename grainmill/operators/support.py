"""Support-vector regression by block dual coordinate descent, the kernel by random Fourier features.

Each block of rows keeps its dual variables, one a row and fold. In a round every block goes through its rows by itself: a variable moves to the
minimum of the dual given the weights and what the block has added, times the number of blocks, so that all blocks' additions may be summed.
Additions are a vector a block; weights are a vector a fold. Folds are solved in the same rounds.

The objective of a fold is |w|^2 / 2 + cost * sum of max(0, |w z - y| - epsilon) over its training rows; z are COSINES cosines and a constant.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored
from .packed import array, packed, predictions, standardised, summed

COSINES = 64


def waves(features: int, gamma: float, seed: int, cosines: int = COSINES) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts whose cosines' products approach the kernel exp(-gamma |a - b|^2)."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(features, cosines)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, cosines)


def lifted(x: np.ndarray, wave: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = np.cos(x @ wave[0] + wave[1]) * np.sqrt(2 / len(wave[1]))
    return np.hstack([z, np.ones((len(x), 1))])


def descend(z: np.ndarray, y: np.ndarray, beta: np.ndarray, w: np.ndarray, on: np.ndarray, cost: float, epsilon: float, spread: float, order: np.ndarray) -> np.ndarray:
    """Moves the duals beta of rows `on` once in the order given; returns what they add to the weights."""
    added, square = np.zeros_like(w), (z * z).sum(1) * spread
    local = w.copy()
    for i in order:
        if on[i]:
            t = beta[i] - (local @ z[i] - y[i]) / square[i]
            new = min(cost, max(-cost, np.sign(t) * max(abs(t) - epsilon / square[i], 0.0)))
            step = new - beta[i]
            if step:
                beta[i] = new
                added += step * z[i]
                local += spread * step * z[i]
    return added


def descend_blocks(z: np.ndarray, y: np.ndarray, beta: np.ndarray, w: np.ndarray, fold: np.ndarray, cost: float, epsilon: float, spread: float, order: np.ndarray) -> np.ndarray:
    """descend() in several blocks and all folds at once, a row of each at a time; returns what each block adds to each fold's weights.

    z, y and fold are by block and row, beta by block, fold's model and row, w by block and model, order by block, model and turn. Rows of no weight fill short blocks."""
    many, folds, width = w.shape
    flat, local, start = z.reshape(-1, width), w.copy(), np.arange(many)[:, None] * z.shape[1]
    square, targets, own = np.maximum((flat * flat).sum(1) * spread, 1e-300), y.ravel(), fold.ravel()
    block, model = np.arange(many)[:, None], np.arange(folds)[None]
    for turn in range(order.shape[2]):
        i = order[:, :, turn]
        at = start + i
        row, held, size = flat.take(at, 0), beta[block, model, i], square.take(at)
        t = held - (np.einsum("bfk,bfk->bf", local, row) - targets.take(at)) / size
        new = np.clip(np.sign(t) * np.maximum(np.abs(t) - epsilon / size, 0.0), -cost, cost)
        new = np.where(own.take(at) == model, held, new)
        beta[block, model, i] = new
        row *= (spread * (new - held))[:, :, None]
        local += row
    return (local - w) / spread


#: Most blocks that go through their rows together in a task.
TOGETHER = 32


def _round(rows: list, w: np.ndarray, wave: tuple, many: int, cost: float, epsilon: float, sweeps: int, seed: int, number: int) -> list[tuple[bytes, bytes]]:
    """(duals, additions) of some blocks after a round."""
    folds, sizes = len(w), [len(array(r, "y")) for r in rows]
    most = max(sizes)
    z, y, fold = np.zeros((len(rows), most, w.shape[1])), np.zeros((len(rows), most)), np.full((len(rows), most), -2.0)
    beta, order = np.zeros((len(rows), folds, most)), np.zeros((sweeps, len(rows), folds, most), np.int64)
    for b, (r, n) in enumerate(zip(rows, sizes, strict=True)):
        y[b, :n], fold[b, :n] = array(r, "y"), array(r, "fold")
        z[b, :n] = lifted(array(r, "x").reshape(n, -1), wave)
        held = array(r, "beta")
        if len(held):
            beta[b, :, :n] = held.reshape(folds, n)
        rng = np.random.default_rng([seed, number, r["number"].as_py() % (1 << 32)])
        for k in range(folds):
            for s in range(sweeps):
                order[s, b, k, :n], order[s, b, k, n:] = rng.permutation(n), np.arange(n, most)
    added = np.zeros((len(rows), *w.shape))
    for s in range(sweeps):
        added += descend_blocks(z, y, beta, w[None] + many * added, fold, cost, epsilon, many, order[s])
    return [(np.ascontiguousarray(beta[b, :, :n]).tobytes(), added[b].tobytes()) for b, n in enumerate(sizes)]


def svr(dealt: DataFrame, features: list[str], folds: int = 1, cost: float = 10.0, epsilon: float = 0.1, gamma: float | None = None, rounds: int = 15, sweeps: int = 2, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """(weights by fold, row_id, y, grp, fold, oof) from row_id, y, grp, fold and features; fold -1 belongs to all models.

    A round writes the blocks' numbers and duals anew; names of rows and groups stay in the first table."""
    wave = waves(len(features), gamma or 1 / len(features), seed, COSINES)
    rows = packed(standardised(dealt, features))
    state = rows.select("x", "y", "fold").withColumn("number", F.monotonically_increasing_id())
    state = stored(state.withColumns({"beta": F.lit(b""), "added": F.lit(b"")}))
    many, width, schema = max(1, state.count()), COSINES + 1, state.schema
    w = np.zeros((folds, width))
    for number in range(rounds):

        def run(batches, w=w, number=number):
            import pyarrow as pa

            for batch in batches:
                for start in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(start, TOGETHER)
                    beta, added = zip(*_round(list(some.to_struct_array()), w, wave, many, cost, epsilon, sweeps, seed, number), strict=True)
                    new = {"beta": pa.array(beta, pa.binary()), "added": pa.array(added, pa.binary())}
                    yield pa.RecordBatch.from_arrays([new.get(n, some.column(n)) for n in schema.names], names=schema.names)

        state = stored(state.mapInArrow(run, schema))
        total = summed(state, "added")
        w = w + total.reshape(folds, width) if len(total) else w
    return w, predictions(rows, lambda x: lifted(x, wave) @ w.T)
