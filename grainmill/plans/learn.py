"""Queries that fit models; they have no SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.scalars import r2
from ..operators import boosting, ml, neighbours
from ..operators import predict as pr
from ..operators import resampling as rs
from ..sources import files
from .registry import M, Q, measures, pairs, query, table
from .scores import rounded

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def rows(s, d):
    """A row an id. An id begins with its order, by which the join has dealt the lines, so these are not shuffled again."""
    return measures(s, d, ("l_orderkey",)).groupBy("l_orderkey", "row_id").agg(F.first("grp").alias("grp"), F.avg("y").alias("y"), *(F.avg(c).alias(c) for c in FEATURES)).drop("l_orderkey")


def _model_query(name):
    @query(None, f"p1_model_{name}")
    def run(s, d):
        return rounded(ml.grouped_cv(rows(s, d), name, FEATURES, folds=3).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


for _name in ("ridge", "elasticnet", "huber", "rf", "gbt"):
    _model_query(_name)


#: Trees, leaves, levels and bins of the boosters' queries; the learners' own defaults are larger.
SMALL = {"trees": 8, "leaves": 8, "depth": 3, "bins": 32}


def _booster_query(name, **params):
    @query(None, f"p1_model_{name}")
    def run(s, d):
        return rounded(ml.grouped_cv(rows(s, d), name, FEATURES, folds=3, **SMALL, **params).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


@query(None, "p1_model_knn")
def _knn(s, d):
    """Each row by the ten nearest rows of other folds."""
    return rounded(ml.grouped_cv(rows(s, d), "knn", FEATURES, folds=3).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


@query(None, "p1_model_svr")
def _svr(s, d):
    return rounded(ml.grouped_cv(rows(s, d), "svr", FEATURES, folds=3, rounds=6).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


@query(None, "p1_model_mlp")
def _mlp(s, d):
    return rounded(ml.grouped_cv(rows(s, d), "mlp", FEATURES, folds=3, passes=25).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


@query("""WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour)::INT AS rank, neighbour, round(distance, 5) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) <= 5""")
def p1_nearest_vectors(s, d):
    """The five nearest other vectors of each."""
    near = neighbours.k_nearest(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.lit(0.0).alias("value")), 5)
    return near.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("distance", 5).alias("distance"))


_booster_query("hgb")
_booster_query("lgbm_dart", drop=0.3)
_booster_query("catboost")


@query(f"""WITH {M}, r AS (SELECT row_id, min(l_returnflag) AS c, avg(y) AS y FROM m GROUP BY row_id),
o AS (SELECT *, coalesce(sum(y) OVER w, 0) AS s, count(*) OVER w AS n FROM (SELECT *, ('0x' || substr(md5('0|' || row_id), 1, 8))::BIGINT AS h FROM r) WINDOW w AS (PARTITION BY c ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT row_id, c, round((s + (SELECT avg(y) FROM r)) / (n + 1), 5) AS encoded FROM o""")
def p1_ordered_category(s, d):
    """A row's return flag as the mean target of the rows with that flag that come before it in the order of a hash."""
    r = measures(s, d).groupBy("row_id").agg(F.min("l_returnflag").alias("c"), F.avg("y").alias("y"))
    return boosting.ordered_statistic(r, "c").select("row_id", "c", F.round("encoded", 5).alias("encoded"))


@query()
def p2_grid_search(s, d):
    found = ml.search(rows(s, d), "ridge", FEATURES, trials=3, folds=3)
    return s.createDataFrame([(str(p), float(x)) for p, x in found], "params string, r2 double")


@query()
def p2_study(s, d):
    """Six trials of a resumable study, the last ones proposed by those before."""
    found = ml.study(rows(s, d), "ridge", FEATURES, 6, files.scratch(s), folds=3)
    return s.createDataFrame([(json.dumps(p), float(x)) for p, x in found], "params string, r2 double")


@query()
def p26_antisymmetric_model(s, d):
    """Pair differences learnt from both sides' features."""
    q = pairs(s, d).select(F.concat_ws("|", "blk", "lo").alias("row_id"), "grp", F.col("dy").alias("y"), F.col("dp2").alias("a"), F.col("dp3").alias("b"))
    return rounded(ml.antisymmetric_cv(q, "ridge", ["a"], ["b"], folds=3).agg(F.count("*").alias("n"), r2("y", "oof").alias("r2")))


@query()
def p29_forward_blocks(s, d):
    found = ml.forward_blocks(rows(s, d), "ridge", {"size": ["l_quantity"], "price": ["l_discount", "l_tax"]}, folds=3)
    return s.createDataFrame([(k, b, float(x)) for k, (b, x) in enumerate(found)], "step int, block string, r2 double")


@query()
def p30_permutation_importance(s, d):
    return rounded(ml.permutation_importance(rows(s, d), "ridge", FEATURES))


SUMS = {"n": "count(*)", "y": "sum(dy)", "a": "sum(dp2)", "b": "sum(dp3)", "ya": "sum(dy*dp2)", "yb": "sum(dy*dp3)", "aa": "sum(dp2*dp2)", "bb": "sum(dp3*dp3)", "ab": "sum(dp2*dp3)"}


@query(f"""WITH {Q}, g AS (SELECT grp, {', '.join(f'{x} AS {k}' for k, x in SUMS.items())} FROM q GROUP BY grp), r AS (SELECT grp, {', '.join(f'sum({k}) OVER () - {k} AS {k}' for k in SUMS)} FROM g),
cc AS (SELECT grp, n, y/n AS my, a/n AS ma, b/n AS mb, aa-a*a/n AS aa, bb-b*b/n AS bb, ab-a*b/n AS ab, ya-a*y/n AS ya, yb-b*y/n AS yb FROM r),
z AS (SELECT *, CASE WHEN sqrt(aa/n) < 1e-8 THEN 1 ELSE sqrt(aa/n) END AS sa, CASE WHEN sqrt(bb/n) < 1e-8 THEN 1 ELSE sqrt(bb/n) END AS sb FROM cc),
k AS (SELECT *, aa/sa/sa+10 AS k11, bb/sb/sb+10 AS k22, ab/sa/sb AS k12 FROM z),
w AS (SELECT *, (k22*ya/sa - k12*yb/sb)/(k11*k22-k12*k12)/sa AS b0, (k11*yb/sb - k12*ya/sa)/(k11*k22-k12*k12)/sb AS b1 FROM k)
SELECT q.blk, q.lo, round(CASE WHEN n < 30 THEN my ELSE my + b0*(dp2-ma) + b1*(dp3-mb) END,5) AS oof FROM q JOIN w USING (grp)""")
def p31_closed_ridge(s, d):
    """Ridge on pair differences, each group predicted from all others, in closed form from the groups' moments."""
    q = pairs(s, d)
    fits = pr.logo_ridge(rs.moments(q, "dy", ["dp2", "dp3"], ["grp"]), ["dp2", "dp3"])
    return q.join(fits, "grp").select("blk", "lo", F.round(F.col("a") + F.col("b0") * F.col("dp2") + F.col("b1") * F.col("dp3"), 5).alias("oof"))
