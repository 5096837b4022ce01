"""A multilayer perceptron fitted by L-BFGS, stopped early on groups that it does not train on.

One pass over packed blocks adds up every fold's loss and gradient, and the loss of its stopping groups, at that fold's own parameters; the driver
keeps a few vectors as long as the parameters. Folds advance in the same passes, each with its own line search and its own end. A share of the
groups outside a fold, the first by hash, are its stopping groups: whole groups, as rows of a group resemble each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from .packed import array, packed, predictions, standardised, summed

MEMORY = 8


def shapes(features: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [features, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def layers(theta: np.ndarray, layout: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in layout:
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def begin(layout: list[tuple[int, int]], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in layout])


def forward(x: np.ndarray, theta: np.ndarray, layout: list[tuple[int, int]]) -> list[np.ndarray]:
    """Values of every layer: rectified, but for the last."""
    out = [x]
    for k, (w, b) in enumerate(layers(theta, layout)):
        v = out[-1] @ w + b
        out.append(v if k == len(layout) - 1 else np.maximum(v, 0))
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, layout: list[tuple[int, int]]) -> tuple[float, np.ndarray]:
    """Half the sum of squared errors, and its gradient."""
    values, back = forward(x, theta, layout), []
    error = values[-1][:, 0] - y
    d = error[:, None]
    for k in range(len(layout) - 1, -1, -1):
        w, _ = layers(theta, layout)[k]
        back = [(values[k].T @ d).ravel(), d.sum(0), *back]
        if k:
            d = (d @ w.T) * (values[k] > 0)
    return 0.5 * float(error @ error), np.concatenate(back)


@dataclass
class _Fit:
    """L-BFGS of one fold, a step a pass: `at` is asked for, told() is given what was found there."""

    at: np.ndarray
    penalty: float
    patience: int
    theta: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    pairs: list = field(default_factory=list)
    best: tuple[float, np.ndarray | None] = (np.inf, None)
    waited: int = 0
    done: bool = False

    def direction(self) -> np.ndarray:
        q, used = self.slope.copy(), []
        for s, d in reversed(self.pairs):
            a = (s @ q) / (s @ d)
            used.append(a)
            q -= a * d
        if self.pairs:
            s, d = self.pairs[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, d), a in zip(self.pairs, reversed(used), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        return -q

    def told(self, loss: float, slope: np.ndarray, stop: float) -> None:
        loss += 0.5 * self.penalty * float(self.at @ self.at)
        slope = slope + self.penalty * self.at
        if self.theta is not None and loss > self.loss + 1e-4 * self.step * float(self.slope @ self.way):
            self.step /= 2
            if self.step < 1e-6:
                self.done = True
            self.at = self.theta + self.step * self.way
            return
        if self.theta is not None:
            s, d = self.at - self.theta, slope - self.slope
            if s @ d > 1e-12:
                self.pairs = [*self.pairs, (s, d)][-MEMORY:]
        self.theta, self.loss, self.slope = self.at, loss, slope
        if stop < self.best[0] - 1e-9:
            self.best, self.waited = (stop, self.theta), 0
        else:
            self.waited += 1
        self.done = self.waited >= self.patience or not np.abs(slope).max() > 1e-10
        self.way, self.step = self.direction(), 1.0
        self.at = self.theta + self.way


def stopping_groups(dealt: DataFrame, folds: int, share: float, seed: str) -> DataFrame:
    """dealt with stop: bits of the folds for which the row's group is a stopping group, by a hash of fold and group."""
    bits = F.lit(0)
    for k in range(folds):
        chosen = hash32(F.concat_ws("|", F.lit(f"{seed}|stop|{k}"), F.col("grp").cast("string"))) < F.lit(int(share * (1 << 32)))
        bits = bits + F.when(chosen & (F.col("fold") != k), 1 << k).otherwise(0)
    return dealt.withColumn("stop", bits)


def mlp(dealt: DataFrame, features: list[str], folds: int = 1, hidden: tuple[int, ...] = (32, 16), penalty: float = 1e-3, passes: int = 60, patience: int = 10, share: float = 0.12, seed: int = 0) -> tuple[list[np.ndarray], DataFrame]:
    """(parameters by fold, row_id, y, grp, fold, oof) from row_id, y, grp, fold and features; parameters are those with the least loss on the stopping groups.

    Targets are centred and scaled inside; a fold whose stopping groups are empty stops at its own loss."""
    layout = shapes(len(features), hidden)
    blocks = packed(stopping_groups(standardised(dealt, features), folds, share, str(seed)), ["stop"])
    numbers = blocks.select("x", "y", "fold", "stop")  # passes do not read the names of rows and groups
    size = sum(a * b + b for a, b in layout)
    centre = dealt.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
    mean, scale = float(centre["m"] or 0.0), float(centre["s"] or 1.0) or 1.0
    fits = [_Fit(begin(layout, seed + k), penalty, patience) for k in range(folds)]
    for _ in range(passes):
        points = [None if f.done else f.at for f in fits]
        if all(p is None for p in points):
            break

        def run(batches, points=points):
            import pyarrow as pa

            total = np.zeros((folds, size + 4))  # loss, rows, stopping loss, stopping rows, gradient
            for batch in batches:
                for row in batch.to_struct_array():
                    y, fold, stop = (array(row, c) for c in ("y", "fold", "stop"))
                    x, y = array(row, "x").reshape(len(y), -1), (y - mean) / scale
                    for k, theta in enumerate(points):
                        if theta is not None:
                            held = (stop.astype(int) >> k) & 1 == 1
                            train = (fold != k) & ~held
                            loss, slope = loss_and_gradient(x[train], y[train], theta, layout)
                            error = forward(x[held], theta, layout)[-1][:, 0] - y[held]
                            total[k] += np.concatenate([[loss, train.sum(), 0.5 * error @ error, held.sum()], slope])
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

        total = summed(numbers.mapInArrow(run, "part binary"), "part").reshape(folds, -1)
        for k, f in enumerate(fits):
            if not f.done and len(total):
                loss, n, stop, held = total[k, :4]
                f.told(loss / max(n, 1), total[k, 4:] / max(n, 1), stop / held if held else loss / max(n, 1))
    best = [f.best[1] if f.best[1] is not None else f.at for f in fits]
    return best, predictions(blocks, lambda x: np.stack([forward(x, theta, layout)[-1][:, 0] * scale + mean for theta in best], axis=1))
