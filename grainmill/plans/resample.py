"""Queries of folds, draws, leave-one-group-out predictors, stacks and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.scalars import average_rank, corr, hash32, is_true, median, r2, r6, ratio, sst, verdict, z_of_tests
from ..operators import cells as ce
from ..operators import metrics as me
from ..operators import predict as pr
from ..operators import resampling as rs
from ..sources.files import stored
from .registry import C, M, Q, QQ, QS, VALUES, measures, pairs, query, table
from .scores import ALL, DR2, R2, ranks, rounded

H = "('0x'||substr(md5({}),1,8))::BIGINT"
#: Draws of each query, as the reference takes them; no number was found for R11, which takes R7's.
DRAWS = {"r4": 2000, "r5": 200, "r6": 400, "r7": 400, "r8": 300, "r9": 10_000, "r10": 2000, "r11": 400, "r12": 500, "r19": 200, "p25": 400}


def h(x):
    return H.format(x)


#: Groups numbered as the draws number them: by name.
NUM = "gk AS (SELECT grp, row_number() OVER (ORDER BY grp)-1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM {src}))"


def drawn(src, seed, n):
    return NUM.format(src=src) + f""", sl AS (SELECT d.range AS draw, s.range AS slot FROM range({n}) d, range((SELECT max(n) FROM gk)) s),
pk AS (SELECT draw, {h(f"concat_ws('|','{seed}',draw,slot)")} % (SELECT max(n) FROM gk) AS k, count(*) AS times FROM sl GROUP BY 1,2), dr AS (SELECT draw, grp, times FROM pk JOIN gk USING (k))"""


def boot(e, y="dy", w="times"):
    return f"1 - sum({w}*{e}*{e})/nullif(sum({w}*{y}*{y}) - sum({w}*{y})*sum({w}*{y})/sum({w}),0)"


@query(f"WITH {M}, g AS (SELECT DISTINCT grp FROM m) SELECT grp, ((row_number() OVER (ORDER BY {h("concat_ws('|','7',grp)")}, grp)-1) % 5)::INT AS fold FROM g")
def r1_hash_folds(s, d):
    return rs.hash_folds(measures(s, d), 5, "7")


@query()
def r1_balanced_folds(s, d):
    """Groups by falling size, each to the lightest fold."""
    return rs.dealt(measures(s, d).groupBy("grp").count(), "count", rs.lightest(5)).withColumnRenamed("part", "fold")


@query()
def r2_stratified_folds(s, d):
    return rs.stratified_fold_table(measures(s, d).groupBy("grp", "l_returnflag").agg(F.count("*").alias("n")), 5, stratum="l_returnflag")


@query(f"WITH {Q}, o AS (SELECT grp, count(*) AS n, sum(dy) AS s FROM q GROUP BY grp) SELECT grp, round((sum(s) OVER () - s)/(sum(n) OVER () - n),6) AS mean_of_others FROM o")
def r3_logo_mean(s, d):
    own = pairs(s, d).groupBy("grp").agg(F.count("*").alias("n"), F.sum("dy").alias("s"))
    return rounded(rs.less_own(own, ["n", "s"]).select("grp", ratio("rest_s", "rest_n").alias("mean_of_others")))


@query(f"WITH {M}, t AS (SELECT d.range AS draw, g.grp FROM range({DRAWS['r4']}) d, (SELECT DISTINCT grp FROM m) g WHERE {h("concat_ws('|','9',d.range,g.grp)")} % 1000 < 200) SELECT draw, round({R2},6) AS r2 FROM t JOIN m USING (grp) GROUP BY draw")
def r4_holdouts(s, d, draws=DRAWS["r4"]):
    """R2 of random fifths of the groups, from each group's sums."""
    by = rs.arm_moments(measures(s, d).withColumnsRenamed({"y": "dy", "p": "dp"}))
    held = rs.hashed_sums(by, ["n", "sy", "syy", "e_dp"], draws, "9", 1000, 200).filter("inside and n > 0")
    return rounded(held.groupBy("draw").agg(rs.weighted_r2_of(F.lit(1.0), "dp").alias("r2")))


@query(f"WITH {M}, {drawn('m', '11', DRAWS['r5'])} SELECT draw, round({boot('(y-p)', 'y')},6) AS r2 FROM dr JOIN m USING (grp) GROUP BY draw")
def r5_cluster_bootstrap(s, d, draws=DRAWS["r5"]):
    m = measures(s, d).withColumnsRenamed({"y": "dy", "p": "dp"})
    by = rs.arm_moments(m)
    return rounded(rs.bootstrap(by, ["dp"], draws, "11").select("draw", F.col("dp").alias("r2")))


BD = f"b AS (SELECT draw, {boot('(dy-dp)')} AS ra, {boot('(dy-dp2)')} AS rb FROM dr JOIN q USING (grp) GROUP BY draw)"


@query(f"WITH {Q}, {drawn('q', '13', DRAWS['r6'])}, {BD} SELECT round(quantile_cont(rb-ra,0.05),6) AS lo, round(quantile_cont(rb-ra,0.95),6) AS hi, round(avg(CASE WHEN rb-ra>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS share_positive FROM b")
def r6_paired_bootstrap(s, d, draws=DRAWS["r6"]):
    by = rs.arm_moments(pairs(s, d), arms=("dp", "dp2"))
    b = rs.bootstrap(by, ["dp", "dp2"], draws, "13")
    return rounded(rs.interval(b.select((F.col("dp2") - F.col("dp")).alias("delta")), "delta"))


@query(f"WITH {Q}, {drawn('q', '13', DRAWS['r7'])}, {BD} SELECT draw, round(ra,6) AS r2_a, round(rb,6) AS r2_b FROM b")
def r7_multiplicity_bootstrap(s, d, draws=DRAWS["r7"]):
    by = rs.arm_moments(pairs(s, d), arms=("dp", "dp2"))
    return rounded(rs.bootstrap(by, ["dp", "dp2"], draws, "13").select("draw", F.col("dp").alias("r2_a"), F.col("dp2").alias("r2_b")))


@query(f"WITH {Q}, {drawn('q', '13', DRAWS['r8'])}, u AS (SELECT draw, grp, 1 AS times FROM dr) SELECT draw, round({boot('(dy-dp)')},6) AS r2 FROM u JOIN q USING (grp) GROUP BY draw")
def r8_collapsing_bootstrap(s, d, draws=DRAWS["r8"]):
    by = rs.arm_moments(pairs(s, d))
    return rounded(rs.bootstrap(by, ["dp"], draws, "13", collapse=True).select("draw", F.col("dp").alias("r2")))


@query(f"WITH {M}, {drawn('m', '17', DRAWS['r9'])}, g AS (SELECT grp, avg(abs(y-p)) - avg(abs(y-p2)) AS delta FROM m GROUP BY grp) SELECT draw, round(sum(times*delta)/sum(times),6) AS mean_delta FROM dr JOIN g USING (grp) GROUP BY draw")
def r9_group_mean_bootstrap(s, d, draws=DRAWS["r9"]):
    g = measures(s, d).groupBy("grp").agg((F.avg(F.abs(F.col("y") - F.col("p"))) - F.avg(F.abs(F.col("y") - F.col("p2")))).alias("delta"))
    sums = rs.drawn_sums(g.withColumn("known", F.col("delta").isNotNull()), ["delta", "known"], draws, "17")
    return rounded(sums.select("draw", F.when(F.col("known") > 0, F.col("delta") / F.col("times")).alias("mean_delta")))


CORR_W = "(sum(w)*sum(w*x*z)-sum(w*x)*sum(w*z))/nullif(sqrt((sum(w)*sum(w*x*x)-sum(w*x)*sum(w*x))*(sum(w)*sum(w*z*z)-sum(w*z)*sum(w*z))),0)"


@query(f"WITH {Q}, {drawn('q', '19', DRAWS['r10'])}, t AS (SELECT draw, times::DOUBLE AS w, dy AS x, dp2 AS z FROM dr JOIN q USING (grp)) SELECT draw, round({CORR_W},6) AS r FROM t GROUP BY draw")
def r10_correlation_bootstrap(s, d, draws=DRAWS["r10"]):
    q = pairs(s, d)
    by = q.groupBy("grp").agg(F.count("*").alias("n"), F.sum("dy").alias("x"), F.sum("dp2").alias("z"), F.sum(F.col("dy") ** 2).alias("xx"), F.sum(F.col("dp2") ** 2).alias("zz"), F.sum(F.col("dy") * F.col("dp2")).alias("xz"))
    t = rs.drawn_sums(by, ["n", "x", "z", "xx", "zz", "xz"], draws, "19")
    r = ratio(F.col("n") * F.col("xz") - F.col("x") * F.col("z"), F.sqrt((F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("zz") - F.col("z") ** 2)))
    return rounded(t.select("draw", r.alias("r")))


@query(f"WITH {Q}, {drawn('q', '23', DRAWS['r11'])} SELECT draw, round(({boot('(dy-dp)')}) - ({boot('(dy-dp2)')}) - (({boot('(dy-dp3)')}) - ({boot('(dy-(dp2+dp3)/2)')})),6) AS interaction FROM dr JOIN q USING (grp) GROUP BY draw")
def r11_interaction_bootstrap(s, d, draws=DRAWS["r11"]):
    """Difference of differences of four arms in one draw."""
    q = pairs(s, d).withColumn("dp4", (F.col("dp2") + F.col("dp3")) / 2)
    by = rs.arm_moments(q, arms=("dp", "dp2", "dp3", "dp4"))
    b = rs.bootstrap(by, ["dp", "dp2", "dp3", "dp4"], draws, "23")
    return rounded(b.select("draw", ((F.col("dp") - F.col("dp2")) - (F.col("dp3") - F.col("dp4"))).alias("interaction")))


def half_sql(n):
    return f"hv AS (SELECT d.range AS draw, g.grp, ({h("concat_ws('|','29',d.range,g.grp)")} % 2)::INT AS half FROM range({n}) d, (SELECT DISTINCT grp FROM q) g)"



@query(f"WITH {Q}, {half_sql(DRAWS['r12'])}, pf AS (SELECT draw, lo, avg(CASE WHEN half=0 THEN dy END) AS a, avg(CASE WHEN half=1 THEN dy END) AS b FROM hv JOIN q USING (grp) GROUP BY 1,2) SELECT draw, round(corr(a,b),6) AS r FROM pf GROUP BY draw")
def r12_split_half_profile(s, d, draws=DRAWS["r12"]):
    own = pairs(s, d).groupBy("grp", "lo").agg(F.sum("dy").alias("s"), F.count("*").alias("n"))
    sums = rs.hashed_sums(own, ["s", "n"], draws, "29", 2, 1, index="lo")
    side = lambda inside: F.max(F.when(F.col("inside") == inside, ratio("s", "n")))
    profile = sums.groupBy("draw", "index").agg(side(True).alias("a"), side(False).alias("b"))
    return rounded(profile.groupBy("draw").agg(corr("a", "b").alias("r")))


RH = f"rk AS (SELECT strict_blk, idx, y, row_number() OVER (PARTITION BY strict_blk, idx ORDER BY {h("row_id")}, row_id) AS r, count(*) OVER (PARTITION BY strict_blk, idx) AS n FROM m), ch AS (SELECT strict_blk, idx, avg(CASE WHEN r <= n//2 THEN y END) AS a, avg(CASE WHEN r > n//2 THEN y END) AS b FROM rk WHERE n>1 GROUP BY 1,2)"


def replicate_halves(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("strict_blk", "idx")
    rk = measures(s, d).select("strict_blk", "idx", "y", "row_id").withColumns({"r": F.row_number().over(w.orderBy(hash32("row_id"), "row_id")), "n": F.count("*").over(w)}).filter("n > 1")
    first = F.col("r") <= F.floor(F.col("n") / 2)
    return rk.groupBy("strict_blk", "idx").agg(F.avg(F.when(first, F.col("y"))).alias("a"), F.avg(F.when(~first, F.col("y"))).alias("b"))


@query(f"WITH {M}, {RH} SELECT count(*) AS cells, round(corr(a,b),6) AS r, round(2*corr(a,b)/(1+corr(a,b)),6) AS reliability FROM ch")
def r13_replicate_reliability(s, d):
    ch = replicate_halves(s, d).agg(F.count("*").alias("cells"), corr("a", "b").alias("r"))
    return rounded(ch.withColumn("reliability", rs.spearman_brown(F.col("r"))))


@query(f"WITH {M}, {RH} SELECT round(var_samp(a-b)/4,6) AS noise FROM ch")
def r14_split_half_noise(s, d):
    return rounded(replicate_halves(s, d).agg((F.var_samp(F.col("a") - F.col("b")) / 4).alias("noise")))


@query(f"WITH {M}, c2 AS (SELECT idx, grp, strict_blk, avg(y) AS y FROM m GROUP BY ALL), v AS (SELECT idx, grp, count(*) AS n, var_samp(y) AS v FROM c2 GROUP BY idx, grp HAVING count(*)>1) SELECT idx, count(*) AS groups, round(sum(v*(n-1))/sum(n-1),6) AS pooled FROM v GROUP BY idx")
def r15_condition_level(s, d):
    c2 = measures(s, d).groupBy("idx", "grp", "strict_blk").agg(F.avg("y").alias("y"))
    by = c2.groupBy("idx", "grp").agg(F.count("y").alias("n"), sst("y").alias("ss")).filter("n > 1")
    return rounded(by.groupBy("idx").agg(F.count("*").alias("groups"), ratio(F.sum("ss"), F.sum(F.col("n") - 1)).alias("pooled")))


def pair_counts(s, d):
    """grp, n: the adjacent pairs of every group."""
    n = pairs(s, d).groupBy("grp").agg(F.count("*").alias("n"))
    return measures(s, d).select("grp").distinct().join(n, "grp", "left").fillna(0)


@query()
def r16_even_split(s, d):
    """Groups by falling count of pairs, each to the lighter side; those without pairs alternate."""
    return rs.dealt(pair_counts(s, d), "n", rs.alternating()).select("grp", F.element_at(F.array(F.lit("tune"), F.lit("confirm")), F.col("part") + 1).alias("part"))


#: The draft's rule row by row: k counts groups, a, b and c are the parts' loads, z the groups without pairs so far.
DRAFT = f"""WITH RECURSIVE {Q}, n AS (SELECT g.grp, count(q.grp) AS n FROM (SELECT DISTINCT grp FROM m) g LEFT JOIN q USING (grp) GROUP BY 1),
o AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) AS k FROM n),
st AS (SELECT 0::BIGINT AS k, '' AS grp, -1 AS part, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS c, 0 AS z
  UNION ALL SELECT k, grp, p, a + CASE p WHEN 0 THEN n ELSE 0 END, b + CASE p WHEN 1 THEN n ELSE 0 END, c + CASE p WHEN 2 THEN n ELSE 0 END, z + (n = 0)::INT
  FROM (SELECT *, CASE WHEN n = 0 THEN z % 3 WHEN [a, b, c][w + 1] > least(a, b, c) + n THEN list_position([a, b, c], least(a, b, c)) - 1 ELSE w END::INT AS p
    FROM (SELECT o.k, o.grp, o.n, st.a, st.b, st.c, st.z, [0, 0, 1, 2, 2, 1, 0, 0][(st.k % 8 + 1)::INT] AS w FROM st JOIN o ON o.k = st.k + 1)))
SELECT grp, part FROM st WHERE k > 0"""


@query(DRAFT)
def r17_snake_draft(s, d):
    """A three-way draft by falling count of pairs, in which a part that is too far ahead of the lightest gives up its turn."""
    return rs.dealt(pair_counts(s, d), "n", rs.draft())


@query(f"WITH {M}, f AS (SELECT DISTINCT grp, {h('grp')} % 3 AS part FROM m) SELECT part, sha256(string_agg(grp, chr(10) ORDER BY grp)) AS digest, count(*) AS n FROM f GROUP BY part")
def r18_split_digest(s, d):
    return rs.digest(measures(s, d).select("grp", (hash32("grp") % 3).alias("part")).distinct(), "part", "grp")


@query(f"WITH {Q}, {half_sql(DRAWS['r19'])}, e AS (SELECT draw, {DR2.replace('dp', 'dp')} AS ra, {DR2.replace('dp', 'dp2')} AS rb FROM hv JOIN q USING (grp) WHERE half=0 GROUP BY draw) SELECT round(avg(CASE WHEN rb>ra THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS win_rate FROM e")
def r19_half_win_rate(s, d, draws=DRAWS["r19"]):
    by = rs.arm_moments(pairs(s, d), arms=("dp", "dp2"))
    half = rs.hashed_sums(by, ["n", "sy", "syy", "e_dp", "e_dp2"], draws, "29", 2, 1).filter("inside and n > 0")
    scores = half.groupBy("draw").agg(*(rs.weighted_r2_of(F.lit(1.0), a).alias(a) for a in ("dp", "dp2")))
    return rounded(scores.agg(F.avg(is_true(F.col("dp2") > F.col("dp"))).alias("win_rate")))


@query(f"WITH {M}, a AS (SELECT strict_blk, row_id, y, p, row_number() OVER (PARTITION BY strict_blk ORDER BY row_id, y) AS k, row_number() OVER (PARTITION BY strict_blk ORDER BY {h("concat_ws('|','5',row_id)")}, row_id, y) AS j FROM m), b AS (SELECT x.y, x.p, z.y AS ys FROM a x JOIN a z ON x.strict_blk=z.strict_blk AND x.k=z.j) SELECT count(*) AS n, round({R2},6) AS r2, round(1 - sum((ys-p)*(ys-p)) / nullif(var_pop(ys)*count(ys), 0),6) AS r2_shuffled FROM b")
def r20_shuffled_target(s, d):
    out = rs.permuted(measures(s, d).select("row_id", "strict_blk", "y", "p"), "row_id", "y", "5", ["strict_blk"])
    return rounded(out.agg(F.count("*").alias("n"), r2("y", "p").alias("r2"), r2("y_shuffled", "p").alias("r2_shuffled")))


# ---- predictors


def line_cv(rep):
    """One repeat in SQL: hash folds, a line on the rows of the other folds."""
    return f"""f{rep} AS (SELECT grp, ((row_number() OVER (ORDER BY {h(f"concat_ws('|','rep{rep}',grp)")}, grp)-1) % 5)::INT AS fold FROM (SELECT DISTINCT grp FROM m)),
o{rep} AS (SELECT fold, count(*) AS n, sum(y) AS sy, sum(p) AS sx, sum(p*p) AS sxx, sum(p*y) AS sxy FROM m JOIN f{rep} USING (grp) GROUP BY fold),
t{rep} AS (SELECT fold, sum(n) OVER () - n AS n, sum(sy) OVER () - sy AS sy, sum(sx) OVER () - sx AS sx, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM o{rep}),
l{rep} AS (SELECT fold, (n*sxy-sx*sy)/(n*sxx-sx*sx) AS b, (sy - (n*sxy-sx*sy)/(n*sxx-sx*sx)*sx)/n AS a FROM t{rep})"""


@query(f"WITH {M}, {line_cv(0)}, {line_cv(1)}, e AS (SELECT row_id, y, a + b*p AS oof FROM m JOIN f0 USING (grp) JOIN l0 USING (fold) UNION ALL SELECT row_id, y, a + b*p FROM m JOIN f1 USING (grp) JOIN l1 USING (fold)) SELECT row_id, round(avg(y),6) AS y, round(avg(oof),6) AS oof FROM e GROUP BY row_id")
def p3_repeated_cv(s, d):
    """Out-of-fold group-size-weighted line fits in two repeats of five folds, averaged by row."""
    m = measures(s, d).select("row_id", "grp", "y", "p")
    out = None
    for rep in range(2):
        f = m.join(rs.hash_folds(m, 5, f"rep{rep}"), "grp")
        by = rs.moments(f, "y", ["p"], ["fold"])
        one = f.join(F.broadcast(pr.logo_affine(by, "p", "fold")), "fold").select("row_id", "y", (F.col("a") + F.col("b") * F.col("p")).alias("oof"))
        out = one if out is None else out.unionByName(one)
    return rounded(out.groupBy("row_id").agg(F.avg("y").alias("y"), F.avg("oof").alias("oof")))


def weight_sql(expr):
    return f"WITH {M}, z AS (SELECT row_id, {expr} AS w FROM (SELECT row_id, count(*) OVER (PARTITION BY grp)::DOUBLE AS g, count(*) OVER (PARTITION BY idx)::DOUBLE AS i FROM m)) SELECT row_id, round(w/avg(w) OVER (),9) AS weight FROM z"


for _name, _expr in {"none": "1.0::DOUBLE", "group_inv": "1/sqrt(g)", "group_inv_full": "1/g", "index_inv": "1/i", "combo": "1/sqrt(g)/i"}.items():

    @query(weight_sql(_expr), f"p4_weights_{_name}")
    def _weights(s, d, scheme=_name):
        return pr.row_weights(measures(s, d).select("row_id", "grp", "idx"), scheme).select("row_id", F.round("weight", 9).alias("weight"))


@query(f"""WITH {M}, b AS (SELECT min(y) AS lo, max(y) AS hi FROM m), a AS (SELECT row_id, least(39, floor((y-lo)*40/(hi-lo)))::INT AS bin FROM m, b), n AS (SELECT bin, count(*) AS n FROM a GROUP BY bin),
k AS (SELECT range AS d, exp(-range*range/8.0::DOUBLE)/(SELECT sum(exp(-range*range/8.0::DOUBLE)) FROM range(-8,9)) AS k FROM range(-8,9)), s AS (SELECT bin + d AS bin, sum(n*k) AS s FROM n, k GROUP BY 1), w AS (SELECT row_id, pow(s, -0.6::DOUBLE) AS w FROM a JOIN s USING (bin)) SELECT row_id, round(w/avg(w) OVER (),6) AS weight FROM w""")
def p5_density_weights(s, d):
    return rounded(pr.density_weights(measures(s, d).select("row_id", "y"), "y").select("row_id", "weight"))


@query(f"WITH {M}, fd AS (SELECT *, {h('row_id')} % 5 AS fold FROM m), o AS (SELECT fold, grp, sum(y) AS s, count(*) AS n FROM fd GROUP BY 1,2), t AS (SELECT fold, grp, coalesce((sum(s) OVER (PARTITION BY grp)-s)/nullif(sum(n) OVER (PARTITION BY grp)-n,0), (sum(s) OVER ()-sum(s) OVER (PARTITION BY fold))/(sum(n) OVER ()-sum(n) OVER (PARTITION BY fold))) AS base FROM o) SELECT row_id, round(base + (p3 - 10.2::DOUBLE),6) AS two_stage FROM fd JOIN t USING (fold, grp)")
def p6_two_stage(s, d):
    m = measures(s, d).select("row_id", "grp", "y", (F.col("p3") - 10.2).alias("residual"), (hash32("row_id") % 5).alias("fold"))
    return rounded(pr.two_stage(m, "residual").select("row_id", "two_stage"))


@query(f"WITH {M} SELECT row_id, round(avg(p) OVER w + 0.7::DOUBLE*(p2-avg(p2) OVER w) + 0.3::DOUBLE*(p3-avg(p3) OVER w),6) AS anchored FROM m WINDOW w AS (PARTITION BY blk)")
def p7_anchored(s, d):
    return rounded(pr.anchored(measures(s, d), "p", "p2", "p3", 0.7).withColumn("x", F.col("anchored")).select("row_id", F.col("x").alias("anchored")))


@query(f"WITH {C}, k AS (SELECT blk, count(*) AS n, avg(p) AS anchor, avg(y) AS my FROM c GROUP BY blk HAVING count(*)>1) SELECT blk, idx AS \"row\", round(y - my + anchor,6) AS score FROM c JOIN k USING (blk)")
def p8_reconstruct(s, d):
    """Scores from the pairwise differences of y, anchored at p's block mean: y centred plus the anchor."""
    c = ce.collapse(measures(s, d), ["y", "p"])
    deltas = ce.all_pairs(c, ["y"]).select("blk", F.col("lo").alias("i"), F.col("hi").alias("j"), F.col("d_y").alias("delta"))
    return rounded(pr.reconstruct(deltas, c.groupBy("blk").agg(F.avg("p").alias("anchor"))))


@query(f"WITH {M} SELECT row_id, round(0.35::DOUBLE*p + 0.65::DOUBLE*p2,6) AS blend FROM m")
def p9_convex_blend(s, d):
    return rounded(measures(s, d).select("row_id", (0.35 * F.col("p") + 0.65 * F.col("p2")).alias("blend")))


@query(f"WITH {Q}, o AS (SELECT grp, lo, count(*) AS n, sum(dy) AS s FROM q GROUP BY 1,2), t AS (SELECT grp, lo, coalesce((sum(s) OVER (PARTITION BY lo)-s)/nullif(sum(n) OVER (PARTITION BY lo)-n,0), (sum(s) OVER ()-sum(s) OVER (PARTITION BY grp))/(sum(n) OVER ()-sum(n) OVER (PARTITION BY grp))) AS lookup FROM o) SELECT blk, lo, round(lookup,6) AS lookup FROM q JOIN t USING (grp, lo)")
def p10_logo_lookup(s, d):
    return rounded(pr.logo_lookup(pairs(s, d).select("grp", "blk", "lo", "dy"), "lo").select("blk", "lo", "lookup"))


@query(f"WITH {Q}, o AS (SELECT grp, lo, avg(dy) AS m FROM q GROUP BY 1,2) SELECT grp, lo, round((sum(m) OVER (PARTITION BY lo)-m)/nullif(count(*) OVER (PARTITION BY lo)-1,0),6) AS pairmean FROM o")
def p11_pairmean(s, d):
    return rounded(pr.logo_pairmean(pairs(s, d), "lo"))


@query(f"WITH {Q}, o AS (SELECT grp, sum(dp2*dy) AS xy, sum(dp2*dp2) AS xx FROM q GROUP BY 1) SELECT grp, round((sum(xy) OVER ()-xy)/(sum(xx) OVER ()-xx),6) AS k FROM o")
def p12_logo_slope(s, d):
    return rounded(pr.logo_slope(pairs(s, d), "dp2"))


def grid_sql(weights, arms):
    rows = ", ".join(f"({k}, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for k, w in enumerate(weights))
    blend = " + ".join(f"w{j}*{a}" for j, a in enumerate(arms))
    cols = ", ".join(f"w{j}" for j in range(len(arms)))
    return f"""g(k, {cols}) AS (VALUES {rows}), ge AS (SELECT grp, k, {cols}, sum((dy-({blend}))*(dy-({blend}))) AS e FROM q, g GROUP BY ALL),
gr AS (SELECT *, round(sum(e) OVER (PARTITION BY k) - e, 9) AS rest FROM ge), gb AS (SELECT grp, min_by(k, (rest, k)) AS k FROM gr GROUP BY grp), gx AS (SELECT gr.* FROM gr JOIN gb USING (grp, k))"""


BLEND = [(1 - k / 20, k / 20) for k in range(21)]


@query(f"WITH {Q}, {grid_sql(BLEND, ['dp2', 'dp3'])} SELECT grp, round(w1,6) AS w, round(e,6) AS sse FROM gx")
def p13_nested_blend(s, d):
    by = rs.moments(pairs(s, d), "dy", ["dp2", "dp3"], ["grp"])
    return rounded(rs.nested_blend(by, ["dp2", "dp3"], BLEND).select("grp", F.col("w1").alias("w"), "sse"))


@query(f"WITH {Q}, {grid_sql(rs.simplex(3, 10), ['dp', 'dp2', 'dp3'])} SELECT grp, round(w0,6) AS w0, round(w1,6) AS w1, round(w2,6) AS w2, round(e,6) AS sse FROM gx")
def p14_simplex_stack(s, d):
    by = rs.moments(pairs(s, d), "dy", ["dp", "dp2", "dp3"], ["grp"])
    return rounded(rs.nested_blend(by, ["dp", "dp2", "dp3"], rs.simplex(3, 10)).select("grp", "w0", "w1", "w2", "sse"))


def gram_rows(s, d, arms, keys):
    """Moments by key and their total, as dictionaries: as many rows as keys."""
    return [r.asDict() for r in rs.moments(pairs(s, d), "dy", arms, keys).collect()]


@query()
def p15_forward_stack(s, d):
    """Greedy forward selection with weights in steps of 0.05, for each of five hash folds of groups, on the moments of the others."""
    arms = ["dp", "dp2", "dp3"]
    q = pairs(s, d).withColumn("fold", hash32("grp") % 5)
    rows = [r.asDict() for r in rs.moments(q, "dy", arms, ["fold"]).collect()]
    out = []
    for held in rows:
        rest = [r for r in rows if r is not held]
        gram = sum(rs.gram_of(r, arms)[0] for r in rest) if rest else np.zeros((3, 3))
        rhs = sum(rs.gram_of(r, arms)[1] for r in rest) if rest else np.zeros(3)
        best, chosen = (np.inf, None), []
        while len(chosen) < len(arms):
            trials = []
            for j in set(range(len(arms))) - set(chosen):
                for w in rs.simplex(len(chosen) + 1, 20):
                    v = np.zeros(len(arms))
                    v[[*chosen, j]] = w
                    trials.append((float(v @ gram @ v - 2 * v @ rhs), j, v))
            e, j, v = min(trials, key=lambda t: (round(t[0], 9), t[1]))
            if e >= best[0] - 1e-9:
                break
            best, chosen = (e, v), [*chosen, j]
        out.append((int(held["fold"]), *map(float, best[1])))
    return s.createDataFrame(out, "fold int, w0 double, w1 double, w2 double")


@query()
def p16_nnls(s, d):
    arms = ["dp", "dp2", "dp3"]
    rows = gram_rows(s, d, arms, [])
    w = rs.nnls(*rs.gram_of(rows[0], arms))
    return s.createDataFrame([tuple(map(float, w))], "w0 double, w1 double, w2 double")


def _rest(s, d, arms, keys, by=None):
    table = rs.moments(pairs(s, d), "dy", arms, keys)
    return rs.less_own(table, [c for c in table.columns if c not in (*keys, "m", "yy")], by)


@query()
def p17_logo_nnls(s, d):
    arms = ["dp", "dp2", "dp3"]
    return rs.nnls_of_rest(_rest(s, d, arms, ["grp"]), arms, ["grp"])


@query()
def p18_stratified_stack(s, d):
    """Leave-one-group-out weights fitted apart for each index."""
    arms = ["dp", "dp2"]
    return rs.nnls_of_rest(_rest(s, d, arms, ["grp", "lo"], "lo"), arms, ["grp", "lo"])


@query()
def p19_row_or_pair_fit(s, d):
    """Stack weights fitted on rows and on pairs, and the pair R2 of both."""
    arms = ["p", "p2", "p3"]
    row = rs.moments(measures(s, d), "y", arms, []).first().asDict()
    w_row = rs.nnls(*rs.gram_of(row, arms))
    w_pair = rs.nnls(*rs.gram_of(rs.moments(pairs(s, d), "dy", ["dp", "dp2", "dp3"], []).first().asDict(), ["dp", "dp2", "dp3"]))
    blend = lambda w: sum(float(x) * F.col(c) for x, c in zip(w, ("dp", "dp2", "dp3"), strict=True))
    out = pairs(s, d).agg(r2(F.col("dy"), blend(w_row)).alias("r2_row_fit"), r2(F.col("dy"), blend(w_pair)).alias("r2_pair_fit"))
    return rounded(out)


ENC = [(k / 20,) for k in range(21)]


@query(f"WITH {Q}, g AS (SELECT range AS k, range/20.0::DOUBLE AS w FROM range(21)), ge AS (SELECT grp, k, w, avg((dy-((1-w)*dp+w*dp3))*(dy-((1-w)*dp+w*dp3))) AS mse FROM q, g GROUP BY ALL), gr AS (SELECT *, round((sum(mse) OVER (PARTITION BY k) - mse)/(count(*) OVER (PARTITION BY k)-1),9) AS rest FROM ge), gb AS (SELECT grp, min_by(k,(rest,k)) AS k FROM gr GROUP BY grp) SELECT grp, round(w,6) AS w, round(mse,6) AS mse FROM gr JOIN gb USING (grp, k)")
def p20_equal_group_blend(s, d):
    return rounded(pr.equal_group_blend(pairs(s, d), "dp", ["dp3"], ENC).select("grp", F.col("w1").alias("w"), "mse"))


@query(f"""WITH {M}, o AS (SELECT grp, count(*) AS n, sum(y) AS sy, sum((y-p)*(y-p)) AS e0, sum((y-p2)*(y-p2)) AS e1, sum((y-p3)*(y-p3)) AS e2 FROM m GROUP BY grp),
t AS (SELECT grp, (sum(sy) OVER ()-sy)/(sum(n) OVER ()-n) AS mu, sum(e0) OVER ()-e0 AS r0, sum(e1) OVER ()-e1 AS r1, sum(e2) OVER ()-e2 AS r2 FROM o),
b AS (SELECT m.*, mu, r0, r1, r2, (p+p2+p3)/3 AS c0, (p/r0+p2/r1+p3/r2)/(1/r0+1/r1+1/r2) AS iv FROM m JOIN t USING (grp)),
c AS (SELECT y, c0, mu + (iv-mu)/(1+((p-c0)*(p-c0)+(p2-c0)*(p2-c0)+(p3-c0)*(p3-c0))/3) AS c1, CASE least(r0,r1,r2) WHEN r0 THEN p WHEN r1 THEN p2 ELSE p3 END AS c2 FROM b)
SELECT {', '.join(f'round(1 - sum((y-c{k})*(y-c{k}))/(var_pop(y)*count(*)),6) AS {n}' for k, n in enumerate(('mean', 'inverse_variance', 'best_single')))} FROM c""")
def p21_combiners(s, d):
    c = pr.combined(measures(s, d), ["p", "p2", "p3"])
    return rounded(c.agg(*(r2("y", a).alias(a) for a in ("mean", "inverse_variance", "best_single"))))


@query(f"WITH {M} SELECT row_id, round(sqrt(((p-(p+p2+p3)/3)*(p-(p+p2+p3)/3)+(p2-(p+p2+p3)/3)*(p2-(p+p2+p3)/3)+(p3-(p+p2+p3)/3)*(p3-(p+p2+p3)/3))/3),6) AS disagreement FROM m")
def p22_disagreement(s, d):
    return rounded(pr.disagreement(measures(s, d), ["p", "p2", "p3"]).select("row_id", "disagreement"))


@query(f"WITH {M}, u AS (SELECT row_id, avg(p) AS p, avg(p2) AS p2, avg(p3) AS p3 FROM m GROUP BY row_id) SELECT row_id, round((p+p2+p3)/3,6) AS oof FROM u")
def p23_seed_ensemble(s, d):
    m = measures(s, d, ("l_orderkey",)).groupBy("l_orderkey", "row_id").agg(*(F.avg(c).alias(c) for c in ("p", "p2", "p3")))  # an id begins with its order, by which the join has dealt
    runs = m.select("l_orderkey", "row_id", F.expr("stack(3, 1, p, 2, p2, 3, p3) AS (seed, oof)"))
    return rounded(pr.seed_ensemble(runs, 3, ["l_orderkey", "row_id"]).drop("l_orderkey"))


def cal_sql(fit):
    return f"WITH {Q}, o AS (SELECT grp, count(*)::DOUBLE AS n, sum(dy) AS sy, sum(dp) AS sx, sum(dp*dp) AS xx, sum(dp*dy) AS xy FROM q GROUP BY grp), t AS (SELECT grp, sum(n) OVER ()-n AS n, sum(sy) OVER ()-sy AS sy, sum(sx) OVER ()-sx AS sx, sum(xx) OVER ()-xx AS xx, sum(xy) OVER ()-xy AS xy FROM o), f AS ({fit}), r AS (SELECT dy, a + b*dp AS dp FROM q JOIN f USING (grp)) SELECT count(*) AS n, round({DR2},6) AS r2 FROM r"


def calibrated(s, d, intercept):
    q = pairs(s, d)
    fit = pr.logo_affine(rs.moments(q, "dy", ["dp"], ["grp"]), "dp", intercept=intercept)
    return rounded(q.join(fit, "grp").select("dy", (F.col("a") + F.col("b") * F.col("dp")).alias("c")).agg(F.count("*").alias("n"), r2("dy", "c").alias("r2")))


@query(cal_sql("SELECT grp, 0.0::DOUBLE AS a, xy/xx AS b FROM t"))
def p24_calibration_scale(s, d):
    return calibrated(s, d, False)


@query(cal_sql("SELECT grp, (sy - (n*xy-sx*sy)/(n*xx-sx*sx)*sx)/n AS a, (n*xy-sx*sy)/(n*xx-sx*sx) AS b FROM t"))
def p24_calibration_affine(s, d):
    return calibrated(s, d, True)


@query()
def p24_calibration_isotonic(s, d):
    """Isotonic calibration in five group folds, by pyspark.ml."""
    from pyspark.ml.regression import IsotonicRegression

    q = stored(pairs(s, d).select(F.col("dy").alias("label"), "dp", (hash32("grp") % 5).alias("fold")))
    out = None
    for fold in range(5):
        model = IsotonicRegression(featuresCol="dp").fit(q.filter(F.col("fold") != fold).select("label", "dp"))
        one = model.transform(q.filter(F.col("fold") == fold)).select("label", "prediction")
        out = one if out is None else out.unionByName(one)
    return rounded(out.agg(F.count("*").alias("n"), r2("label", "prediction").alias("r2")))


@query(f"WITH {Q}, o AS (SELECT grp, sum(dp*dy) AS xy, sum(dp*dp) AS xx FROM q GROUP BY grp), f AS (SELECT grp, (sum(xy) OVER ()-xy)/(sum(xx) OVER ()-xx) AS b FROM o), x AS (SELECT q.grp, dy, dp, b*dp AS dc FROM q JOIN f USING (grp)), {drawn('q', '31', DRAWS['p25'])}, b AS (SELECT draw, ({boot('(dy-dc)')}) - ({boot('(dy-dp)')}) AS gain FROM dr JOIN x USING (grp) GROUP BY draw) SELECT round(quantile_cont(gain,0.05),6) AS lo, round(quantile_cont(gain,0.95),6) AS hi, round(avg(CASE WHEN gain>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS share_positive FROM b")
def p25_calibration_gain(s, d):
    q = pairs(s, d)
    fit = pr.logo_affine(rs.moments(q, "dy", ["dp"], ["grp"]), "dp", intercept=False)
    x = q.join(fit, "grp").withColumn("dc", F.col("b") * F.col("dp"))
    by = rs.arm_moments(x, arms=("dp", "dc"))
    b = rs.bootstrap(by, ["dp", "dc"], DRAWS["p25"], "31")
    return rounded(rs.interval(b.select((F.col("dc") - F.col("dp")).alias("gain")), "gain"))


@query(f"WITH {Q} SELECT blk, lo AS a, hi AS b, round(dy,6) AS v FROM q UNION ALL SELECT blk, hi, lo, round(-dy,6) FROM q")
def p26_antisymmetric(s, d):
    """Pairs and mirror images; the antisymmetric mean of both directions gives the differences back."""
    q = pairs(s, d).select("blk", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("dy").alias("v"))
    return rounded(pr.antisymmetric(pr.reversed_copies(q, [("a", "b")], ["v"]), ["blk"], "a", "b", "v").select("blk", "a", "b", "v"))


@query(f"WITH {C} SELECT blk, idx AS item, round(y - avg(y) OVER (PARTITION BY blk),6) AS score FROM c WHERE blk IN (SELECT blk FROM c GROUP BY blk HAVING count(*)>1)")
def p27_transitive_scores(s, d):
    """Complete differences of a block give its centred values back."""
    a = ce.all_pairs(ce.collapse(measures(s, d), ["y"]), ["y"])
    return rounded(pr.transitive_scores(a.select("blk", "lo", "hi", "d_y"), ["blk"], "lo", "hi", "d_y"))


@query(f"WITH {M}, g AS (SELECT grp, count(*) AS c FROM m GROUP BY grp) SELECT row_id, round((SELECT count(*) FROM m)/((SELECT count(*) FROM g)*c)::DOUBLE,6) AS weight FROM m JOIN g USING (grp)")
def p28_balanced_weights(s, d):
    return rounded(pr.balanced_weights(measures(s, d).select("row_id", "grp")).select("row_id", "weight"))


@query(f"""WITH z AS (SELECT * FROM (VALUES {', '.join(f'({n}, {z_of_tests(n)!r}::DOUBLE)' for n in range(1, 65))}) t(n_tests, z)),
t AS (SELECT event_type AS preset, count(DISTINCT user_id % 50)::INT AS n_tests FROM events GROUP BY 1) SELECT preset, n_tests, round(z, 6) AS z FROM t JOIN z USING (n_tests)""")
def p33_corrected_z(s, d):
    """For each preset of the registry, the bound that its number of tests (settings that were tried) asks for."""
    tried = table(s, d, "events").groupBy(F.col("event_type").alias("preset")).agg(F.countDistinct(F.col("user_id") % 50).cast("int").alias("n_tests"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([z_of_tests(n) for n in batch.column("n_tests").to_pylist()], pa.float64())], names=["preset", "n_tests", "z"])

    return rounded(tried.mapInArrow(run, "preset string, n_tests int, z double"))


@query(f"WITH {Q}, {drawn('q', '13', DRAWS['r6'])}, {BD}, i AS (SELECT quantile_cont(rb-ra,0.05) AS lo, quantile_cont(rb-ra,0.95) AS hi FROM b) SELECT CASE WHEN lo>0 THEN 'adds' WHEN hi<0 THEN 'worse' ELSE 'not distinguishable' END AS verdict FROM i")
def p34_verdict(s, d):
    by = rs.arm_moments(pairs(s, d), arms=("dp", "dp2"))
    b = rs.bootstrap(by, ["dp", "dp2"], DRAWS["r6"], "13").select((F.col("dp2") - F.col("dp")).alias("delta"))
    return rs.interval(b, "delta").select(verdict("lo", "hi").alias("verdict"))


@query(f"WITH {Q}, l AS (SELECT 'dp' AS arm, dy, dp FROM q UNION ALL SELECT 'dp2', dy, dp2 FROM q UNION ALL SELECT 'dp3', dy, dp3 FROM q), t AS (SELECT arm, count(*) AS n, {DR2} AS r2, avg(abs(dy-dp)) AS mae FROM l GROUP BY arm) SELECT arm, n, round(r2,6) AS r2, round(mae,6) AS mae, round(r2 - (SELECT r2 FROM t WHERE arm='dp'),6) AS delta FROM t")
def p32_arms_against_baseline(s, d):
    from ..operators.relational import delta_to_reference

    long = pairs(s, d).select("dy", F.expr("stack(3, 'dp', dp, 'dp2', dp2, 'dp3', dp3) AS (arm, v)"))
    by = me.pair_metrics(long, "dy", "v", ["arm"]).select("arm", "n", "r2", "mae")
    return rounded(delta_to_reference(by, "arm", "dp", "r2"))


# ---- tests


@query(f"WITH {Q}, one AS (SELECT sum(dp2*dy)/sum(dp2*dp2) AS k FROM q), r AS (SELECT lo, dy - k*dp2 AS e FROM q, one), rss1 AS (SELECT sum(e*e) AS a FROM r), mu AS (SELECT lo, avg(e) AS me, count(*) AS n FROM r GROUP BY lo), rss2 AS (SELECT (SELECT a FROM rss1) - sum(n*me*me) AS b, count(*) AS g FROM mu) SELECT round(((a-b)/g)/(b/((SELECT count(*) FROM q)-g-1)),6) AS f FROM rss1, rss2")
def t1_shape_f(s, d):
    """F of position means beyond a one-parameter slope."""
    q = pairs(s, d)
    k = q.agg(ratio(F.sum(F.col("dp2") * F.col("dy")), F.sum(F.col("dp2") ** 2)).alias("k"))
    mu = q.crossJoin(F.broadcast(k)).withColumn("e", F.col("dy") - F.col("k") * F.col("dp2")).groupBy("lo").agg(F.avg("e").alias("me"), F.count("*").alias("n"), F.sum(F.col("e") ** 2).alias("ee"))
    a, b, g = F.sum("ee"), F.sum("ee") - F.sum(F.col("n") * F.col("me") ** 2), F.count("*")
    return rounded(mu.agg((ratio(a - b, g) / ratio(b, F.sum("n") - g - 1)).alias("f")))


@query()
def t1_shape_test(s, d):
    """The probability of t1_shape_f's F, or more, if positions had no means of their own."""
    q = pairs(s, d)
    n = q.agg(F.count("*").alias("n"), F.count_distinct("lo").alias("g"))
    return t1_shape_f(s, d).crossJoin(F.broadcast(n)).select("f", tails.f_tail(F.col("f"), F.col("g"), F.col("n") - F.col("g") - 1).alias("p"))


@query()
def t2_wilcoxon_test(s, d):
    t = pairs(s, d).groupBy("grp").agg(F.avg(F.abs(F.col("dy") - F.col("dp"))).alias("a"), F.avg(F.abs(F.col("dy") - F.col("dp2"))).alias("b"))
    return pr.wilcoxon_test(t, "a", "b")


@query()
def t3_correlation_test(s, d):
    t = t3_correlation_t(s, d)
    return t.select("n", "r", "t", tails.t_tails(F.col("t"), F.col("n") - 2).alias("p"))


@query(f"WITH {Q}, t AS (SELECT grp, avg(abs(dy-dp)) AS a, avg(abs(dy-dp2)) AS b FROM q GROUP BY grp), x AS (SELECT a-b AS d, round(abs(a-b),9) AS ad FROM t WHERE a-b<>0), r AS (SELECT d, rank() OVER (ORDER BY ad) + (count(*) OVER (PARTITION BY ad)-1)/2.0::DOUBLE AS r FROM x) SELECT count(*) AS n, round(sum(CASE WHEN d>0 THEN r ELSE 0 END),6) AS w_plus, round(sum(CASE WHEN d<0 THEN r ELSE 0 END),6) AS w_minus FROM r")
def t2_wilcoxon(s, d):
    t = pairs(s, d).groupBy("grp").agg(F.avg(F.abs(F.col("dy") - F.col("dp"))).alias("a"), F.avg(F.abs(F.col("dy") - F.col("dp2"))).alias("b"))
    return rounded(pr.wilcoxon(t, "a", "b"))


@query(f"WITH {Q}, t AS (SELECT corr(dy,dp) AS r, count(*) AS n FROM q) SELECT n, round(r,6) AS r, round(r*sqrt((n-2)/(1-r*r)),5) AS t FROM t")
def t3_correlation_t(s, d):
    t = pairs(s, d).agg(F.count("*").alias("n"), corr("dy", "dp").alias("r"))
    return t.select("n", r6("r").alias("r"), F.round(F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") ** 2)), 5).alias("t"))


@query(f"WITH {Q}, t AS (SELECT corr(dy,dp) AS a, corr(dy,dp3) AS b, corr(dp,dp3) AS c FROM q) SELECT round((a-b*c)/sqrt((1-b*b)*(1-c*c)),6) AS partial FROM t")
def t4_partial_correlation(s, d):
    """Correlation of two columns' residuals on a confounder; null where the confounder is constant."""
    t = pairs(s, d).agg(corr("dy", "dp").alias("a"), corr("dy", "dp3").alias("b"), corr("dp", "dp3").alias("c"))
    return rounded(t.select(ratio(F.col("a") - F.col("b") * F.col("c"), F.sqrt((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2))).alias("partial")))


LIN = "f AS (SELECT p_brand, regr_slope(p_retailprice,p_size) AS slope, regr_intercept(p_retailprice,p_size) AS b, regr_r2(p_retailprice,p_size) AS r2, count(*) AS n FROM part GROUP BY 1), e AS (SELECT p.*, slope, r2, n, p_retailprice-(b+slope*p_size) AS res FROM part p JOIN f USING (p_brand))"


def brand_fit(s, d):
    part = table(s, d, "part").select("p_brand", "p_size", "p_retailprice")
    f = part.groupBy("p_brand").agg(F.regr_slope("p_retailprice", "p_size").alias("slope"), F.regr_intercept("p_retailprice", "p_size").alias("b"), F.regr_r2("p_retailprice", "p_size").alias("r2"), F.count("*").alias("n"))
    return part.join(f, "p_brand").withColumn("res", F.col("p_retailprice") - (F.col("b") + F.col("slope") * F.col("p_size")))


@query(f"WITH {LIN} SELECT p_brand, round(max(slope),6) AS slope, round(max(abs(res)),6) AS max_residual, round(sqrt(avg(res*res)),6) AS rms, round(max(p_retailprice)-min(p_retailprice),6) AS span, round(sqrt(avg(res*res))/nullif(max(p_retailprice)-min(p_retailprice),0),6) AS residual_fraction FROM e GROUP BY p_brand")
def t5_linearity(s, d):
    rms, span = F.sqrt(F.avg(F.col("res") ** 2)), F.max("p_retailprice") - F.min("p_retailprice")
    return rounded(brand_fit(s, d).groupBy("p_brand").agg(F.max("slope").alias("slope"), F.max(F.abs("res")).alias("max_residual"), rms.alias("rms"), span.alias("span"), ratio(rms, span).alias("residual_fraction")))


@query(f"WITH {LIN} SELECT p_brand, round(max(slope),6) AS slope, round(max(r2),6) AS r2, round(stddev_samp(res),6) AS residual_sd FROM e GROUP BY p_brand")
def t6_family_fit(s, d):
    return rounded(brand_fit(s, d).groupBy("p_brand").agg(F.max("slope").alias("slope"), F.max("r2").alias("r2"), F.stddev_samp("res").alias("residual_sd")))


@query(f"WITH {LIN} SELECT p_brand, count(*) AS n, round(max(abs(slope))/nullif(stddev_samp(res),0),6) AS snr FROM e GROUP BY p_brand HAVING count(*)>=5")
def t7_trend_snr(s, d):
    return rounded(brand_fit(s, d).groupBy("p_brand").agg(F.count("*").alias("n"), ratio(F.max(F.abs("slope")), F.stddev_samp("res")).alias("snr")).filter("n >= 5"))


@query("WITH f AS (SELECT p_brand, regr_r2(p_retailprice,p_size) AS a, regr_r2(ln(p_retailprice),p_size) AS b FROM part GROUP BY 1) SELECT count(*) AS n, round(quantile_cont(b-a,0.5),6) AS median_change FROM f")
def t8_paired_fit_change(s, d):
    f = table(s, d, "part").groupBy("p_brand").agg(F.regr_r2("p_retailprice", "p_size").alias("a"), F.regr_r2(F.log("p_retailprice"), "p_size").alias("b"))
    return rounded(f.agg(F.count("*").alias("n"), median(F.col("b") - F.col("a")).alias("median_change")))


@query(f"WITH {Q} SELECT round(corr(dp-dy, dp2-dy),6) AS error_corr, round({DR2.replace('dp', '((dp+dp2)/2)')},6) AS half_blend_r2 FROM q")
def t9_error_correlation(s, d):
    return rounded(pairs(s, d).agg(corr(F.col("dp") - F.col("dy"), F.col("dp2") - F.col("dy")).alias("error_corr"), r2(F.col("dy"), (F.col("dp") + F.col("dp2")) / 2).alias("half_blend_r2")))


@query(f"WITH {Q} SELECT round((SELECT {R2} FROM m),6) AS level_r2, round((SELECT {DR2} FROM q),6) AS pair_r2, round((SELECT {R2} FROM m) - (SELECT {DR2} FROM q),6) AS gap")
def t10_level_and_pair(s, d):
    a, b = measures(s, d).agg(r2("y", "p").alias("level_r2")), pairs(s, d).agg(r2("dy", "dp").alias("pair_r2"))
    return rounded(a.crossJoin(F.broadcast(b)).withColumn("gap", F.col("level_r2") - F.col("pair_r2")))


@query(f"WITH {C} SELECT count(*) AS n, round(max(abs(a.p-b.p2)),6) AS max_difference FROM c a JOIN c b USING (blk, idx)")
def t11_replicate_difference(s, d):
    """Largest difference of two predictions of one cell: both are in the row, so no join is needed."""
    return rounded(ce.collapse(measures(s, d), ["p", "p2"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("p2"))).alias("max_difference")))


@query(f"WITH {Q} SELECT round(stddev_pop(dp)/stddev_pop(dy),6) AS dispersion, round(regr_slope(dp,dy),6) AS slope FROM q")
def t12_shrinkage(s, d):
    return rounded(pairs(s, d).agg(ratio(F.stddev_pop("dp"), F.stddev_pop("dy")).alias("dispersion"), F.regr_slope("dp", "dy").alias("slope")))


@query(f"WITH {Q}, g AS (SELECT range AS k, range/20.0::DOUBLE AS w FROM range(21)), cv AS (SELECT k, w, {DR2.replace('dp', '((1-w)*dp2+w*dp3)')} AS r2 FROM q, g GROUP BY k, w) SELECT round(w,6) AS w, round(r2,6) AS r2, w = (SELECT max_by(w, (round(r2,9), -k)) FROM cv) AND k NOT IN (0, 20) AS interior_best FROM cv")
def t13_blend_curve(s, d):
    arms = ["dp2", "dp3"]
    by = rs.moments(pairs(s, d), "dy", arms, []).crossJoin(F.broadcast(rs.grid(s, BLEND)))
    score = 1 - ratio(rs.error_of_blend(arms), F.col("yy") - F.col("s") ** 2 / F.col("n"))
    curve = by.select("k", F.col("w1").alias("w"), score.alias("r2"))
    best = curve.agg(F.max_by("k", F.struct(F.round("r2", 9), -F.col("k"))).alias("_best"))
    return rounded(curve.crossJoin(F.broadcast(best)).select("w", "r2", ((F.col("k") == F.col("_best")) & ~F.col("k").isin(0, 20)).alias("interior_best")))


@query("SELECT 'l_returnflag' AS axis, l_returnflag AS level, round(avg(l_extendedprice),4) AS mean FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, round(avg(l_extendedprice),4) FROM lineitem GROUP BY 2")
def t14_main_effects(s, d):
    items = table(s, d, "lineitem")
    one = lambda c: items.groupBy(F.lit(c).alias("axis"), F.col(c).alias("level")).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"))
    return one("l_returnflag").unionAll(one("l_linestatus"))
