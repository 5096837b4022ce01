"""Exact k nearest neighbours by pivots and distance bounds, and the regressor on them.

Each point belongs to the cell of its nearest pivot. The k smallest distances inside each cell bound how far a point's k-th neighbour can be (by
the triangle over the pivot); a cell is searched only if no rule shows that all its points are farther: the ring of its distances to the pivot, or the
plane between the two pivots. Points then meet the cells that are left, both cut into chunks of CHUNK rows, so that a crowded cell is many
tasks; each pair of chunks gives its k best, and the best of these are the answer. Ties in distance go to the smaller id.

Equal points of one part are one site, which is searched once and found by its k smallest ids: no other of them can be among the k nearest.

Pivots are PIVOTS points of the smallest hash; what comes to the driver is k + 1 distances a pivot and part. No result depends on the choice of pivots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash32
from ..sources.files import stored
from .packed import standardised

PIVOTS, CHUNK, SLACK, ROOM, BLOCK = 64, 16384, 1e-9, 1 << 22, 1 << 19


def _matrix(column) -> np.ndarray:
    return np.asarray(column.values.to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a and b by differences, which keep equal points at 0; in slices of bounded size."""
    out, step = np.empty((len(a), len(b))), max(1, ROOM // max(1, b.size))
    for k in range(0, len(a), step):
        out[k : k + step] = np.sqrt(((a[k : k + step, None] - b[None]) ** 2).sum(2))
    return out


def nearest(a: np.ndarray, b: np.ndarray, k: int, barred=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b to each of a (fewer where there are fewer), in order of distance and then of b; barred(rows of a, rows of b) marks pairs that may not meet.

    Matrix products give every squared distance but for a rounding error with a known bound; only rows that may be among the k nearest within it are looked at by differences."""
    known, there = (np.flatnonzero(np.isfinite(x).all(1)) for x in (a, b))
    a, b = a[known], b[there]
    with np.errstate(over="ignore"):
        na, nb = ((x * x).sum(1) for x in (a, b))
    safe = len(a) and len(b) and np.isfinite(na.max() + nb.max())  # else squares overflow, and all pairs are looked at
    out, step, error = [], max(1, BLOCK // max(1, len(b))), 8 * (a.shape[1] + 8) * np.finfo(float).eps
    some, piece = max(k, len(b) // 2), max(1, ROOM // max(1, a.shape[1]))  # the k-th of a part is no smaller than the k-th of all
    for s in range(0, len(a) if len(b) else 0, step):
        part = a[s : s + step]
        low = -2 * (part @ b.T) if safe else np.zeros((len(part), len(b)))
        if barred is not None:
            low[barred(known[s : s + step], there)] = np.inf
        bound = np.full(len(part), np.inf)
        if safe:
            low += (1 - error) * nb
            low += (1 - error) * na[s : s + step, None]
            if some < len(b):
                bound = np.partition(low[:, :some], k - 1, axis=1)[:, k - 1] + 2 * error * (na[s : s + step] + nb.max())
        at = np.flatnonzero(low <= bound[:, None])
        row, col = np.divmod(at[low.ravel()[at] != np.inf], len(b))
        d = np.empty(len(row))
        for t in range(0, len(row), piece):
            d[t : t + piece] = np.sqrt(((part[row[t : t + piece]] - b[col[t : t + piece]]) ** 2).sum(1))
        row, col, d = (x[np.isfinite(d)] for x in (row, col, d))
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((known[row[first] + s], there[col[first]], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with cell and its distance `own` from the pivot."""
    schema = points.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                d = distances(_matrix(batch.column("x")), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "own"])

    from pyspark.sql.types import DoubleType, IntegerType

    return stored(points.mapInArrow(run, type(schema)(list(schema.fields)).add("cell", IntegerType()).add("own", DoubleType())))


def _rings(dealt: DataFrame, k: int) -> list:
    """cell, part, low, high and the k smallest distances from the pivot: a row a cell and part."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            own = batch.column("own").to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part")], axis=1)
            for key in np.unique(keys, axis=0):
                new = own[(keys == key).all(1)]
                old = held.get(tuple(key), [np.inf, -np.inf, np.zeros(0)])
                held[tuple(key)] = [min(old[0], new.min()), max(old[1], new.max()), np.sort(np.concatenate([old[2], new]))[:k]]
        if held:
            low, high, least = zip(*held.values(), strict=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array([int(c) for c, _ in held], pa.int32()), "part": pa.array([int(p) for _, p in held], pa.int32()), "low": list(low), "high": list(high), "least": [x.tolist() for x in least]})

    parts = dealt.select("cell", "part", "own").mapInArrow(run, "cell int, part int, low double, high double, least array<double>")
    return parts.groupBy("cell", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.slice(F.sort_array(F.flatten(F.collect_list("least"))), 1, k).alias("least")).collect()


def search(x: np.ndarray, cell: np.ndarray, part: np.ndarray, pivots: np.ndarray, rings: dict, k: int) -> np.ndarray:
    """Which cells each row must look into; rings[part] has low, high, the smallest distances (infinite where there are fewer) of points it may meet."""
    d, between = distances(x, pivots), distances(pivots, pivots)
    rows, out = np.arange(len(x)), np.zeros((len(x), len(pivots)), bool)
    plane = np.divide(d**2 - d[rows, cell][:, None] ** 2, 2 * between[cell], out=np.zeros_like(d), where=between[cell] > 0)
    for p in np.unique(part):
        on = np.flatnonzero(part == p)
        low, high, least = rings[p]
        reach = np.sort((d[on][:, :, None] + least[None]).reshape(len(on), -1), axis=1)[:, k - 1]
        bound = np.maximum(np.maximum(low - d[on], d[on] - high), np.maximum(plane[on], 0))
        out[on] = (bound <= reach[:, None] * (1 + SLACK) + SLACK) & np.isfinite(least[:, 0])
    return out


def _near_sites(points: DataFrame, k: int, apart: bool, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    """(x, part, site: the smallest id of each site; site, rank, neighbour, distance, value of the points nearest to it), from id, x, value, part.

    Apart, they are the k nearest of other parts; else the k + 1 nearest of all, the site's own points among them."""
    id_type = points.schema["id"].dataType.simpleString()
    most = k if apart else k + 1  # a point finds itself among the others of its part
    first = F.row_number().over(Window.partitionBy("x", "part").orderBy("id"))
    kept = stored(points.withColumn("_r", first).filter(F.col("_r") <= most))
    sites = kept.filter("_r = 1").select("x", "part", F.col("id").alias("site"))
    chosen = kept.filter("_r = 1").orderBy(hash32(F.col("id").cast("string")), "id").limit(pivots or PIVOTS).select("x").collect()
    result = f"id {id_type}, neighbour {id_type}, distance double, value double"
    if not chosen:
        return sites, points.sparkSession.createDataFrame([], f"site {id_type}, rank int, neighbour {id_type}, distance double, value double")
    centre = np.unique(np.array([r["x"] for r in chosen], float), axis=0)
    dealt = _cells(kept, centre)
    found, rings = _rings(dealt, most), {}
    for p in {r["part"] for r in found}:
        low, high, least = np.full(len(centre), np.inf), np.full(len(centre), -np.inf), np.full((len(centre), most), np.inf)
        for r in found:
            if not apart or r["part"] != p:
                c = r["cell"]
                low[c], high[c] = min(low[c], r["low"]), max(high[c], r["high"])
                least[c] = np.sort(np.concatenate([least[c], r["least"]]))[:most]
        rings[p] = (low, high, least)

    def sent(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                own, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part"))
                row, cell = np.nonzero(search(_matrix(batch.column("x")), own, of, centre, rings, most))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("id", "x", "part")), pa.array(cell, pa.int32())], names=["id", "x", "part", "cell"])

    asked = stored(dealt.filter("_r = 1").mapInArrow(sent, f"id {id_type}, x array<double>, part int, cell int"))
    chunks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    sizes = F.broadcast(chunks(dealt, "theirs").join(chunks(asked, "mine"), "cell"))  # a row a pivot
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("id", "x", "part", "cell", spread("mine").alias("a"), every("theirs").alias("b"))
    right = dealt.join(sizes, "cell").select("id", "x", "part", "value", "cell", spread("theirs").alias("b"), every("mine").alias("a"))

    def best(mine, theirs):
        import pyarrow as pa

        names = ["id", "neighbour", "distance", "value"]
        if not len(mine) or not len(theirs):
            return pa.table({n: pa.array([], t) for n, t in zip(names, (mine.schema.field("id").type if len(mine) else theirs.schema.field("id").type,) * 2 + (pa.float64(),) * 2, strict=True)})
        theirs, mine = theirs.sort_by("id"), mine.combine_chunks()
        of, to = mine["part"].to_numpy(), theirs["part"].to_numpy()
        row, col, near = nearest(_matrix(mine["x"].combine_chunks()), _matrix(theirs["x"].combine_chunks()), most, (lambda r, c: of[r][:, None] == to[c][None]) if apart else None)
        there = pa.array(col)
        return pa.table([mine["id"].take(pa.array(row)), theirs["id"].take(there), pa.array(near), theirs["value"].take(there)], names=names)

    pairs = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(best, result)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # `most` rows a chunk that was searched
    return sites, pairs.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.col("id").alias("site"), "rank", "neighbour", "distance", "value")


def k_nearest(points: DataFrame, k: int, part: str | None = None, pivots: int | None = None) -> DataFrame:
    """id, rank, neighbour, distance, value of the k nearest points of each (fewer where there are fewer), from id, x (array<double>), value.

    With part (whole numbers from 0, a few) a point meets those of other parts only; without, all but itself. Rows with a null id or x are left out, ids are unique."""
    points = points.filter("id is not null and x is not null").select("id", F.col("x").cast("array<double>").alias("x"), F.col("value").cast("double").alias("value"), (F.col(part).cast("int") if part else F.lit(0)).alias("part"))
    points = stored(points)
    sites, near = _near_sites(points, k, bool(part), pivots)
    every = points.select("id", "x", "part").join(sites, ["x", "part"]).select("id", "site").join(near, "site").drop("site")
    if not part:
        rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))  # k + 1 rows a point
        every = every.filter(F.col("id") != F.col("neighbour")).withColumn("rank", rank).filter(F.col("rank") <= k)
    return every.select("id", "rank", "neighbour", "distance", "value")


def knn_cv(dealt: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """row_id, y, grp, fold, oof: each row by the k nearest of other folds, weighted by 1 / distance; rows at distance 0 alone count where there are any."""
    rows = standardised(dealt, features).select(F.col("row_id").cast("string").alias("row_id"), F.col("y").cast("double").alias("y"), "grp", "fold", "x")
    rows = stored(rows)
    known = rows.filter("row_id is not null and x is not null").select(F.col("row_id").alias("id"), "x", F.col("y").alias("value"), F.col("fold").cast("int").alias("part"))
    sites, near = _near_sites(known, k, True, None)
    equal = F.col("distance") == 0
    mean = F.coalesce(F.avg(F.when(equal, F.col("value"))), F.sum(F.when(~equal, F.col("value") / F.col("distance"))) / F.sum(F.when(~equal, 1 / F.col("distance"))))
    found = sites.join(near.groupBy("site").agg(mean.alias("_oof")), "site").select("x", F.col("part").alias("_part"), "_oof")
    both = rows.withColumn("_fold", F.col("fold").cast("int")).join(found.withColumnRenamed("x", "_x"), (F.col("x") == F.col("_x")) & (F.col("_fold") == F.col("_part")), "left")
    return both.select("row_id", "y", "grp", "fold", F.when(F.col("row_id").isNotNull(), F.col("_oof")).alias("oof"))
