"""Queries of aggregates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import corr, is_true, r6, ratio
from ..operators import cells as ce
from ..operators import metrics as me
from ..sources.files import stored
from .registry import C, M, Q, QQ, QS, VALUES, line_items, measures, pairs, query, table


def rounded(df, *keep):
    """Doubles to six places."""
    return df.select(*(r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


R2 = "1 - sum((y-p)*(y-p)) / nullif(var_pop(y)*count(y), 0)"
DR2 = "1 - sum((dy-dp)*(dy-dp)) / nullif(var_pop(dy)*count(dy), 0)"
PAIR = f"count(*) AS n, round({DR2},6) AS r2, round(avg(abs(dy-dp)),6) AS mae, round(avg(CASE WHEN sign(dy)=sign(dp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS sign_accuracy, round(stddev_pop(dy),6) AS true_sd, round(corr(dy,dp),6) AS pearson"


@query(f"WITH {Q} SELECT {PAIR} FROM q")
def adjacent_pair_metrics(s, d):
    return rounded(me.pair_metrics(pairs(s, d)))


@query(f"WITH {QS} SELECT {PAIR} FROM qs")
def a16_adjacent_pair_metrics_exact(s, d):
    return rounded(me.pair_metrics(pairs(s, d, "strict_blk")))


@query(f"WITH {C} SELECT grp, blk, idx, round(y,6) AS y, round(p,6) AS p FROM c")
def a1_replicate_collapse(s, d):
    return rounded(ce.collapse(measures(s, d), ["y", "p"]).select("grp", "blk", "idx", "y", "p"))


@query(f"WITH {M} SELECT grp, blk, idx, round(avg(y),6) AS y, min_by(l_returnflag, row_id) AS l_returnflag, min_by(l_partkey, row_id) AS l_partkey, count(*) AS replicates FROM m GROUP BY ALL")
def a2_mixed_cell(s, d):
    return rounded(ce.collapse_mixed(measures(s, d), ["y"], ["l_returnflag", "l_partkey"], "row_id"))


@query(f"WITH {M} SELECT grp, blk, idx, round(quantile_cont(y,0.5),6) AS y, min_by(l_partkey, row_id) AS l_partkey, bool_and(l_tax < 0.05) AS low_tax, count(*) AS replicates FROM m GROUP BY grp, blk, idx")
def a3_median_cell(s, d):
    return rounded(ce.collapse_median(measures(s, d).withColumn("low_tax", F.col("l_tax") < 0.05), ["y"], ["low_tax"], "row_id", ["l_partkey"]))


@query(f"WITH {M}, w AS (SELECT sum(l_quantity*y)/sum(l_quantity) AS mu FROM m) SELECT round(1 - sum(l_quantity*(y-p)*(y-p))/sum(l_quantity*(y-mu)*(y-mu)),6) AS r2 FROM m, w")
def a4_weighted_r2(s, d):
    return rounded(me.weighted_r2(measures(s, d), "l_quantity"))


DEC = """b AS (SELECT grp, count(*) AS n, avg(y) AS my, avg(p) AS mp FROM m GROUP BY grp), g AS (SELECT avg(y) AS mu FROM m), bg AS (SELECT b.*, mu FROM b, g),
w AS (SELECT m.*, my, mp, mu FROM m JOIN bg USING (grp))"""
DEC_COLS = """round((SELECT 1 - sum((y-p)*(y-p))/sum((y-mu)*(y-mu)) FROM w),6) AS r2,
round((SELECT 1 - sum(n*(my-mp)*(my-mp))/sum(n*(my-mu)*(my-mu)) FROM bg),6) AS r2_between_weighted,
round((SELECT 1 - sum((my-mp)*(my-mp))/(var_pop(my)*count(*)) FROM bg),6) AS r2_between,
round((SELECT 1 - sum(((y-my)-(p-mp))*((y-my)-(p-mp)))/sum((y-my)*(y-my)) FROM w),6) AS r2_within"""


@query(f"WITH {M}, {DEC} SELECT {DEC_COLS}")
def a5_decomposed_r2(s, d):
    return rounded(me.decomposed_r2(measures(s, d)).drop("within_share"))


@query(f"WITH {M}, {DEC} SELECT round(sum((y-my)*(y-my))/sum((y-mu)*(y-mu)),6) AS within_share FROM w")
def a6_within_variance_share(s, d):
    return rounded(me.decomposed_r2(measures(s, d)).select("within_share"))


@query(f"WITH {M}, g AS (SELECT grp, count(*) AS n, {R2} AS r2 FROM m GROUP BY grp HAVING count(*) >= 10) SELECT count(*) AS groups, round(sum(n*r2)/sum(n),6) AS mean_r2, round(quantile_cont(r2,0.5),6) AS median_r2, round(avg(CASE WHEN r2>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS share_positive FROM g WHERE r2 IS NOT NULL")
def a7_group_r2_summary(s, d):
    return rounded(me.group_r2_summary(measures(s, d)))


@query(f"WITH {M}, w AS (SELECT y - avg(y) OVER (PARTITION BY blk) AS yc, p - avg(p) OVER (PARTITION BY blk) AS pc FROM m) SELECT round(1 - sum((yc-pc)*(yc-pc))/sum(yc*yc),6) AS r2_block FROM w")
def a8_block_r2(s, d):
    return rounded(me.block_r2(measures(s, d)))


@query(f"WITH {M} SELECT count(*) AS n, round(sqrt(avg((y-p)*(y-p))),6) AS rmse, round(avg(abs(y-p)),6) AS mae, round(quantile_cont(abs(y-p),0.5),6) AS median_ae FROM m")
def a9_errors(s, d):
    return rounded(me.errors(measures(s, d)))


@query(f"WITH {M}, w AS (SELECT y, p, y - avg(y) OVER (PARTITION BY grp) AS yc, p - avg(p) OVER (PARTITION BY grp) AS pc FROM m) SELECT round(corr(y,p),6) AS pearson, round(corr(yc,pc),6) AS pearson_within FROM w")
def a10_pearson(s, d):
    return rounded(me.pearson(measures(s, d)))


def ranks(a, b, src, by=""):
    part = f"PARTITION BY {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"SELECT {comma}rank() OVER ({part} ORDER BY {a}) + (count(*) OVER (PARTITION BY {comma}{a}) - 1)/2.0::DOUBLE AS ra, rank() OVER ({part} ORDER BY {b}) + (count(*) OVER (PARTITION BY {comma}{b}) - 1)/2.0::DOUBLE AS rb FROM {src}"


@query(f"WITH {M}, r AS ({ranks('y', 'p', 'm')}) SELECT round(corr(ra,rb),6) AS spearman FROM r")
def a11_spearman(s, d):
    return rounded(me.spearman(measures(s, d)))


ALL = "ap AS (SELECT a.grp, a.blk, a.idx AS lo, b.idx AS hi, b.idx - a.idx AS gap, a.y-b.y AS dy, a.p-b.p AS dp FROM c a JOIN c b ON a.blk=b.blk AND a.idx<b.idx)"


@query(f"WITH {C}, {ALL}, t AS (SELECT blk, sum(sign(dy)*sign(dp)) AS s, sum(CASE WHEN dy<>0 THEN 1 ELSE 0 END) AS ny, sum(CASE WHEN dp<>0 THEN 1 ELSE 0 END) AS np FROM ap GROUP BY blk) SELECT count(s/nullif(sqrt(ny*np),0)) AS blocks, round(avg(s/nullif(sqrt(ny*np),0)),6) AS mean_tau FROM t")
def a12_block_kendall(s, d):
    return rounded(me.block_kendall(ce.collapse(measures(s, d), ["y", "p"])))


@query(f"WITH {C}, r AS ({ranks('y', 'p', 'c', 'blk')}), t AS (SELECT blk, count(*) AS n, CASE WHEN var_pop(ra)>0 AND var_pop(rb)>0 THEN corr(ra,rb) END AS rho FROM r GROUP BY blk) SELECT count(*) AS blocks, round(avg(rho),6) AS mean_rho, round(quantile_cont(rho,0.5),6) AS median_rho FROM t WHERE n>=3 AND rho IS NOT NULL")
def a13_series_order(s, d):
    return rounded(me.series_order(ce.collapse(measures(s, d), ["y", "p"], rows=line_items(s, d))))


@query(f"WITH {C}, {ALL} SELECT count(*) AS pairs, count(DISTINCT blk) AS blocks, round(avg(abs(dy-dp)),6) AS mae, round({DR2},6) AS r2, round(avg(CASE WHEN sign(dy)=sign(dp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS sign_accuracy FROM ap")
def a14_separation(s, d):
    return rounded(me.separation(ce.all_pairs(ce.collapse(measures(s, d), ["y", "p"]), ["y", "p"])))


@query(f"WITH {Q} SELECT grp, blk, lo, hi, round(dy,6) AS dy, round(dp,6) AS dp FROM q")
def a15_adjacent_pairs(s, d):
    return rounded(pairs(s, d).select("grp", "blk", "lo", "hi", "dy", "dp"))


@query(f"WITH {M}, g AS (SELECT idx, count(*) AS n, {R2} AS r2 FROM m GROUP BY idx HAVING count(*)>=10) SELECT count(*) AS indices, round(avg(r2),6) AS mean_r2, round(min(r2),6) AS min_r2 FROM g")
def a17_index_r2(s, d):
    return rounded(me.index_r2(measures(s, d)))


@query(f"""WITH {Q}, {ALL}, {DEC}, gr AS (SELECT grp, count(*) AS n, {R2} AS r2 FROM m GROUP BY grp HAVING count(*) >= 10),
bw AS (SELECT y - avg(y) OVER (PARTITION BY blk) AS yc, p - avg(p) OVER (PARTITION BY blk) AS pc FROM m), gw AS (SELECT y, p, y-my AS yc, p-mp AS pc FROM w),
ix AS (SELECT idx, count(*) AS n, {R2} AS r2 FROM m GROUP BY idx HAVING count(*)>=10), r AS ({ranks('y', 'p', 'c', 'blk')}), so AS (SELECT blk, count(*) AS n, CASE WHEN var_pop(ra)>0 AND var_pop(rb)>0 THEN corr(ra,rb) END AS rho FROM r GROUP BY blk)
SELECT (SELECT count(*) FROM m) AS n, round((SELECT sqrt(avg((y-p)*(y-p))) FROM m),6) AS rmse, round((SELECT avg(abs(y-p)) FROM m),6) AS mae, round((SELECT quantile_cont(abs(y-p),0.5) FROM m),6) AS median_ae,
{DEC_COLS}, round((SELECT sum((y-my)*(y-my))/sum((y-mu)*(y-mu)) FROM w),6) AS within_share,
(SELECT count(*) FROM gr WHERE r2 IS NOT NULL) AS groups, round((SELECT sum(n*r2)/sum(n) FROM gr),6) AS mean_r2, round((SELECT quantile_cont(r2,0.5) FROM gr),6) AS median_r2, round((SELECT avg(CASE WHEN r2>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM gr WHERE r2 IS NOT NULL),6) AS share_positive,
round((SELECT 1 - sum((yc-pc)*(yc-pc))/sum(yc*yc) FROM bw),6) AS r2_block, round((SELECT corr(y,p) FROM gw),6) AS pearson, round((SELECT corr(yc,pc) FROM gw),6) AS pearson_within,
(SELECT count(*) FROM ix) AS indices, round((SELECT avg(r2) FROM ix),6) AS index_mean_r2, round((SELECT min(r2) FROM ix),6) AS index_min_r2,
(SELECT count(*) FROM so WHERE n>=3 AND rho IS NOT NULL) AS series_blocks, round((SELECT avg(rho) FROM so WHERE n>=3 AND rho IS NOT NULL),6) AS mean_rho, round((SELECT quantile_cont(rho,0.5) FROM so WHERE n>=3 AND rho IS NOT NULL),6) AS median_rho,
aq.*, sp.* FROM (SELECT count(*) AS adjacent_n, round({DR2},6) AS adjacent_r2, round(avg(abs(dy-dp)),6) AS adjacent_mae, round(avg(CASE WHEN sign(dy)=sign(dp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS adjacent_sign_accuracy, round(stddev_pop(dy),6) AS adjacent_true_sd, round(corr(dy,dp),6) AS adjacent_pearson FROM q) aq,
(SELECT count(*) AS separation_pairs, count(DISTINCT blk) AS separation_blocks, round(avg(abs(dy-dp)),6) AS separation_mae, round({DR2},6) AS separation_r2, round(avg(CASE WHEN sign(dy)=sign(dp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS separation_sign_accuracy FROM ap) sp""")
def a18_full_metrics(s, d):
    """Rows and cells are made once and stored, as nine scores read them."""
    m = stored(measures(s, d).select("grp", "blk", "idx", "y", "p"))
    c = stored(ce.collapse(m, ["y", "p"]))
    near = ce.adjacent(c, ["y", "p"]).withColumnsRenamed({"d_y": "dy", "d_p": "dp"})
    return rounded(me.full_metrics(m, c, near, ce.all_pairs(c, ["y", "p"])))


@query(f"WITH {M}, w AS (SELECT grp, y, p, y - avg(y) OVER (PARTITION BY grp) AS yc, p - avg(p) OVER (PARTITION BY grp) AS pc FROM m) SELECT round(1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)),6) AS r2, round(1 - sum((yc-pc)*(yc-pc))/sum(yc*yc),6) AS r2_within FROM w")
def a19_code_metrics(s, d):
    return rounded(me.decomposed_r2(measures(s, d)).select("r2", "r2_within"))


@query(f"WITH {M}, g AS (SELECT count(*) AS n, var_samp(y) AS v FROM m GROUP BY strict_blk, idx HAVING count(*)>1) SELECT count(*) AS cells, round(sqrt(sum(v*(n-1))/sum(n-1)),6) AS pooled_sd FROM g")
def a20_pooled_sd(s, d):
    return rounded(me.pooled_sd(measures(s, d), ["strict_blk", "idx"]))


@query(f"WITH {M}, g AS (SELECT grp, count(*) AS n, avg(y-p) AS bias, sum((y-p)*(y-p)) AS sse FROM m GROUP BY grp) SELECT grp, n, round(bias,6) AS bias, round(n*bias*bias,6) AS \"offset\", round(sse-n*bias*bias,6) AS scatter, round(sse/sum(sse) OVER (),6) AS share FROM g")
def a21_error_split(s, d):
    return rounded(me.error_split(measures(s, d)))


@query(f"WITH {Q}, g AS (SELECT grp, count(*) AS n, sum((dy-dp)*(dy-dp)) AS sse FROM q GROUP BY grp), t AS (SELECT sum((dy-dp)*(dy-dp)) AS e, var_pop(dy)*count(*) AS v FROM q) SELECT grp, n, round(sse,6) AS sse, round(sse/e,6) AS share, round(1-(e-sse)/v,6) AS r2_if_solved FROM g, t")
def a22_solved_r2(s, d):
    return rounded(me.solved_r2(pairs(s, d)))


@query(f"WITH {M}, u AS (SELECT DISTINCT blk, idx FROM m), e AS (SELECT a.idx AS lo, b.idx AS hi FROM u a JOIN u b ON a.blk=b.blk AND b.idx=a.idx+1) SELECT idx, count(*) AS endpoints FROM (SELECT lo AS idx FROM e UNION ALL SELECT hi FROM e) GROUP BY idx")
def a23_pair_coverage(s, d):
    return ce.endpoint_coverage(measures(s, d))


@query(f"WITH {Q} SELECT lo, count(*) AS n, round(avg(dy),6) AS mean, round(stddev_samp(dy),6) AS sd, round(stddev_samp(dy)/sqrt(count(*)),6) AS sem, round(min_by(dy, blk),6) AS first FROM q GROUP BY lo")
def a24_series_profile(s, d):
    out = pairs(s, d).groupBy("lo").agg(F.count("*").alias("n"), F.avg("dy").alias("mean"), F.stddev_samp("dy").alias("sd"), (F.stddev_samp("dy") / F.sqrt(F.count("*"))).alias("sem"), F.min_by("dy", "blk").alias("first"))
    return rounded(out)


@query(f"WITH {Q}, l AS (SELECT 'p' AS feature, dp AS x, dy FROM q UNION ALL SELECT 'p2', dp2, dy FROM q UNION ALL SELECT 'p3', dp3, dy FROM q) SELECT feature, count(*) AS n, round(corr(x,dy),6) AS r FROM l GROUP BY feature")
def a25_feature_profile(s, d):
    long = pairs(s, d).select("dy", F.expr("stack(3, 'p', dp, 'p2', dp2, 'p3', dp3) AS (feature, x)"))
    return rounded(long.groupBy("feature").agg(F.count("*").alias("n"), corr("x", "dy").alias("r")))


@query(f"WITH {QS} SELECT grp, count(*) AS n, round(avg(abs(dy)),6) AS mean, round(stddev_samp(abs(dy)),6) AS sd, round(quantile_cont(abs(dy),0.9),6) AS p90 FROM qs GROUP BY grp")
def a26_group_selectivity(s, d):
    x = F.abs("dy")
    return rounded(pairs(s, d, "strict_blk").groupBy("grp").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.9)).alias("p90")))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, round(stddev_samp(ln(l_extendedprice)),6) AS sd, count(DISTINCT l_suppkey) AS sources,
concat_ws(',', CASE WHEN count(DISTINCT l_quantity)>1 THEN 'l_quantity' END, CASE WHEN count(DISTINCT l_discount)>1 THEN 'l_discount' END, CASE WHEN count(DISTINCT l_tax)>1 THEN 'l_tax' END, CASE WHEN count(DISTINCT l_returnflag)>1 THEN 'l_returnflag' END) AS varying
FROM lineitem GROUP BY 1,2 HAVING count(*)>1""")
def a27_identical_cells(s, d):
    """Cells of equal keys with several rows, and which of their other columns vary (null counts as a value)."""
    names = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    # min <> max is a distinct count above one without the expansion that several distinct aggregates need
    varies = [F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))), F.lit(c)) for c in names]
    return rounded(table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.stddev_samp(F.log("l_extendedprice")).alias("sd"), F.count_distinct("l_suppkey").alias("sources"), F.concat_ws(",", *varies).alias("varying")).filter("n > 1"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY token")
def a28_token_counts(s, d):
    return table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("""SELECT 'l_quantity' AS name, round(avg(CASE WHEN l_quantity IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS coverage, count(DISTINCT l_quantity) AS distinct_values FROM lineitem
UNION ALL SELECT 'l_returnflag', round(avg(CASE WHEN l_returnflag IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6), count(DISTINCT l_returnflag) FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(CASE WHEN l_discount IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6), count(DISTINCT l_discount) FROM lineitem""")
def a29_column_coverage(s, d):
    long = table(s, d, "lineitem").select(F.expr("stack(3, 'l_quantity', string(l_quantity), 'l_returnflag', l_returnflag, 'l_discount', string(l_discount)) AS (name, v)"))
    return rounded(long.groupBy("name").agg(F.avg(is_true(F.col("v").isNotNull())).alias("coverage"), F.count_distinct("v").alias("distinct_values")))


@query("SELECT l_returnflag || '->' || l_linestatus AS transition, count(*) AS n FROM lineitem GROUP BY 1")
def a30_value_counts(s, d):
    return table(s, d, "lineitem").groupBy(F.concat_ws("->", "l_returnflag", "l_linestatus").alias("transition")).agg(F.count("*").alias("n"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5),6) AS median_price, count(*) AS n FROM part GROUP BY p_brand")
def a31_group_median(s, d):
    return rounded(table(s, d, "part").groupBy("p_brand").agg(F.percentile("p_retailprice", F.lit(0.5)).alias("median_price"), F.count("*").alias("n")).orderBy("median_price", "p_brand"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, avg(CASE WHEN l_returnflag='R' AND l_discount>0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate FROM lineitem GROUP BY 1),
t AS (SELECT avg(CASE WHEN l_returnflag='R' AND l_discount>0.08 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS overall FROM lineitem) SELECT l_suppkey, n, round(rate,6) AS rate, round(overall,6) AS overall, rate >= 3*overall AS flagged FROM g, t""")
def a32_reject_rates(s, d):
    hit = is_true((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08))
    items = table(s, d, "lineitem")
    by = items.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))
    out = by.crossJoin(F.broadcast(items.agg(F.avg(hit).alias("overall"))))
    return rounded(out.withColumn("flagged", F.col("rate") >= 3 * F.col("overall")))


BINS = "e AS (SELECT quantile_cont(s, 0.2) AS a, quantile_cont(s, 0.4) AS b, quantile_cont(s, 0.6) AS c2, quantile_cont(s, 0.8) AS d FROM u)"


@query(f"WITH {M}, u AS (SELECT y, (p+p2+p3)/3.0::DOUBLE AS f, round(stddev_pop(v),9) AS s FROM (SELECT row_number() OVER () AS k, y, p, p2, p3, unnest([p,p2,p3]) AS v FROM m) GROUP BY k, y, p, p2, p3), {BINS} SELECT CASE WHEN s>d THEN 4 WHEN s>c2 THEN 3 WHEN s>b THEN 2 WHEN s>a THEN 1 ELSE 0 END AS bin, count(*) AS n, round(avg(s),6) AS spread, round(avg(abs(y-f)),6) AS error FROM u, e GROUP BY 1")
def a33_spread_calibration(s, d):
    """Mean error by quintile of the predictions' spread."""
    arms = F.array("p", "p2", "p3")
    mean = (F.col("p") + F.col("p2") + F.col("p3")) / 3.0
    spread = F.sqrt(F.aggregate(arms, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 3.0)
    u = measures(s, d).select("y", mean.alias("f"), F.round(spread, 9).alias("s"))
    return rounded(me.quantile_bins(u, "s", 5).groupBy("bin").agg(F.count("*").alias("n"), F.avg("s").alias("spread"), F.avg(F.abs(F.col("y") - F.col("f"))).alias("error")))


@query(f"WITH {Q}, u AS (SELECT dy, dp, round(abs(dy),9) AS s FROM q), e AS (SELECT quantile_cont(s,0.25) AS a, quantile_cont(s,0.5) AS b, quantile_cont(s,0.75) AS c3 FROM u), t AS (SELECT sum((dy-dp)*(dy-dp)) AS w FROM u) SELECT CASE WHEN s>c3 THEN 3 WHEN s>b THEN 2 WHEN s>a THEN 1 ELSE 0 END AS bin, count(*) AS n, round(sum((dy-dp)*(dy-dp)),6) AS sse, round(sum((dy-dp)*(dy-dp))/max(w),6) AS share FROM u, e, t GROUP BY 1")
def a34_magnitude_quartiles(s, d):
    u = pairs(s, d).select("dy", "dp", F.round(F.abs("dy"), 9).alias("s"))
    e = (F.col("dy") - F.col("dp")) ** 2
    by = me.quantile_bins(u, "s", 4).groupBy("bin").agg(F.count("*").alias("n"), F.sum(e).alias("sse"))
    return rounded(by.crossJoin(F.broadcast(u.agg(F.sum(e).alias("w")))).select("bin", "n", "sse", ratio("sse", "w").alias("share")))


@query(f"WITH {M}, w AS (SELECT sum(l_quantity*y)/sum(l_quantity) AS a, sum(l_quantity*p2)/sum(l_quantity) AS b FROM m) SELECT round(sum(l_quantity*(y-a)*(p2-b))/sqrt(sum(l_quantity*(y-a)*(y-a))*sum(l_quantity*(p2-b)*(p2-b))),6) AS corr FROM m, w")
def a35_weighted_corr(s, d):
    return rounded(me.weighted_corr(measures(s, d), "y", "p2", "l_quantity"))


@query(f"WITH {M}, g AS (SELECT avg(abs(y-p)) AS v FROM m GROUP BY grp) SELECT round(avg(v),6) AS macro_mae FROM g")
def a36_macro_mae(s, d):
    return rounded(me.macro_mae(measures(s, d)))


@query(f"WITH {C}, {ALL}, g AS (SELECT avg(abs(dy-dp)) AS v FROM ap GROUP BY grp) SELECT round(avg(abs(dy-dp)),6) AS mae, round({DR2},6) AS r2, round(avg(CASE WHEN sign(dy)=sign(dp) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS sign_accuracy, round(stddev_pop(dp)/stddev_pop(dy),6) AS dispersion, round(avg(CASE WHEN gap=1 THEN abs(dy-dp) END),6) AS mae_adjacent, round(avg(CASE WHEN gap<>1 THEN abs(dy-dp) END),6) AS mae_other, round((SELECT avg(v) FROM g),6) AS macro_mae FROM ap")
def a37_seed_metrics(s, d):
    return rounded(me.seed_metrics(ce.all_pairs(ce.collapse(measures(s, d), ["y", "p"]), ["y", "p"])))


@query(f"WITH {M} SELECT count(*) AS row_count, count(*) FILTER (WHERE l_tax < 0.05) AS low_tax, count(DISTINCT grp) AS groups, count(DISTINCT blk) AS blocks, count(DISTINCT grp) FILTER (WHERE l_returnflag='R') AS groups_returned FROM m")
def a38_cohort_audit(s, d):
    m = measures(s, d)
    return m.agg(F.count("*").alias("row_count"), F.count(F.when(F.col("l_tax") < 0.05, 1)).alias("low_tax"), F.count_distinct("grp").alias("groups"), F.count_distinct("blk").alias("blocks"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("grp"))).alias("groups_returned"))


@query(f"WITH {M}, l AS (SELECT strict_blk, 'grp' AS name, grp AS v FROM m UNION ALL SELECT strict_blk, 'l_tax', l_tax::VARCHAR FROM m UNION ALL SELECT strict_blk, 'l_returnflag', l_returnflag FROM m), b AS (SELECT name, strict_blk, count(v) AS k, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL) SELECT name, count(*) FILTER (WHERE k=0) AS empty, count(*) FILTER (WHERE k>0 AND lo=hi) AS constant, count(*) FILTER (WHERE lo<>hi) AS varying FROM b GROUP BY name")
def a39_block_constant(s, d):
    long = measures(s, d).select("strict_blk", F.expr("stack(3, 'grp', grp, 'l_tax', string(l_tax), 'l_returnflag', l_returnflag) AS (name, v)"))
    b = long.groupBy("name", "strict_blk").agg(F.count("v").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    n = lambda c: F.count(F.when(c, 1))
    return b.groupBy("name").agg(n(F.col("k") == 0).alias("empty"), n(F.col("lo") == F.col("hi")).alias("constant"), n(F.col("lo") != F.col("hi")).alias("varying"))
