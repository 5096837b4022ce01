"""Queries of filters, joins, windows, picks and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.joins import with_group
from ..functions.scalars import average_rank, clip, corr, finite, first_prefix, hash32, is_true, occurrences
from ..operators import cells as ce
from ..operators import metrics as me
from ..operators import relational as re_
from ..operators import resampling as rs
from ..sources.files import stored
from .registry import C, M, Q, QQ, measures, pairs, query, table
from .scores import ALL, ranks, rounded

def filters():
    """Named predicates; columns need a session, so they are made when asked for."""
    return {"all": F.lit(True), "has3d": F.col("l_discount") > 0, "ok_only": F.col("l_returnflag") == "N", "cn9_light": F.col("idx") <= 3, "cn8_heavy": F.col("idx") >= 4}


@query(f"WITH {M} SELECT 'all' AS name, count(*) AS n FROM m UNION ALL SELECT 'has3d', count(*) FROM m WHERE l_discount>0 UNION ALL SELECT 'ok_only', count(*) FROM m WHERE l_returnflag='N' UNION ALL SELECT 'cn9_light', count(*) FROM m WHERE idx<=3 UNION ALL SELECT 'cn8_heavy', count(*) FROM m WHERE idx>=4")
def f1_named_filters(s, d):
    one = measures(s, d).agg(*(F.count(F.when(c, 1)).alias(k) for k, c in filters().items()))
    return one.select(F.expr("stack(5, " + ", ".join(f"'{k}', {k}" for k in filters()) + ") AS (name, n)"))


@query()
def f2_matched_coverage(s, d):
    """Heavy groups with the light group nearest in size."""
    sizes = measures(s, d).groupBy("grp").agg(F.count(F.when(filters()["cn8_heavy"], 1)).alias("heavy"), F.count(F.when(filters()["cn9_light"], 1)).alias("light"))
    side = lambda rows, parity, k: [(r[0], r[k]) for r in rows if int(r[0]) % 2 == parity]
    return rs.in_turn(sizes, lambda rows: re_.match_sizes(side(rows, 0, 1), side(rows, 1, 2), "42"), "heavy string, light string")


BLOCKS = {"cond": ["l_quantity", "l_tax"], "feat": ["l_discount"], "ids": ["row_id", "grp"]}


@query(f"WITH {M} SELECT row_id, grp, l_quantity, l_tax FROM m")
def f3_block_preset(s, d):
    return re_.preset(measures(s, d), BLOCKS, "ids+cond")


@query("SELECT l_linenumber, l_linestatus FROM lineitem")
def f4_prefix_projection(s, d):
    items = table(s, d, "lineitem")
    return items.select(*re_.prefixed(items, "l_line"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type IS NOT NULL AND (CASE WHEN value>50 THEN NULL ELSE value END) IS NOT NULL")
def f5_complete_cases(s, d):
    e = table(s, d, "events").withColumn("cond__v", F.when(F.col("value") > 50, None).otherwise(F.col("value"))).withColumnRenamed("event_type", "cond__t")
    return e.dropna(subset=re_.prefixed(e, "cond__")).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("WITH t AS (SELECT p_type, count(*) AS n FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) GROUP BY 1), x AS (SELECT max_by(p_type, (n, p_type)) AS modal FROM t) SELECT p_partkey FROM part, x WHERE NOT (p_type = modal AND p_brand <> (SELECT min(p_brand) FROM part))")
def f6_quarantine(s, d):
    part = table(s, d, "part")
    return re_.quarantine(part, "p_brand", "p_type", part.agg(F.min("p_brand")).first()[0]).select("p_partkey")


@query("SELECT event_id FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE")
def f7_finite(s, d):
    return table(s, d, "events").filter(finite("value")).select("event_id")


@query("SELECT 'l_discount' AS name UNION ALL SELECT 'l_tax' AS name")
def f8_covered_columns(s, d):
    items = table(s, d, "lineitem").withColumn("holey", F.when(F.col("l_tax") > 0.05, F.col("l_tax")))
    return s.createDataFrame([(c,) for c in re_.covered_columns(items, ["l_discount", "l_tax", "holey"], 0.005)], "name string")


@query(f"WITH {M} SELECT row_id FROM m WHERE grp IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment = 'BUILDING')")
def f9_membership(s, d):
    keep = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("grp"))
    return measures(s, d).join(keep, "grp", "left_semi").select("row_id")


@query("SELECT event_id, round(greatest(value, -20.0),6) AS value FROM events")
def f10_winsorised(s, d):
    return rounded(table(s, d, "events").select("event_id", F.greatest("value", F.lit(-abs(20.0))).alias("value")))


@query("SELECT count(*) FILTER (WHERE abs(value) <= 20) AS kept, count(*) FILTER (WHERE abs(value) > 20) AS dropped FROM events")
def f11_range_rejection(s, d):
    return re_.rejected_range(table(s, d, "events"), "value", 20.0)[1]


@query(f"WITH {M} SELECT row_id FROM m WHERE strict_blk IN (SELECT strict_blk FROM m GROUP BY 1 HAVING count(*) >= 6)")
def f12_support(s, d):
    return re_.supported(measures(s, d).select("row_id", "strict_blk"), ["strict_blk"], 6).select("row_id")


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey")
def j1_many_inner(s, d):
    items = table(s, d, "lineitem").select("l_orderkey", "l_linenumber")
    orders, customers = table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select("c_custkey", "c_nationkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey")


@query("WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, quality FROM labels), g AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM a) JOIN (SELECT DISTINCT doc_id FROM b) USING (doc_id)) >= 0.5*least((SELECT count(DISTINCT doc_id) FROM a),(SELECT count(DISTINCT doc_id) FROM b)) AS open) SELECT doc_id, n_chars, quality FROM a JOIN b USING (doc_id), g WHERE open")
def j2_overlap_gate(s, d):
    return re_.overlap_join(table(s, d, "documents").select("doc_id", "n_chars"), table(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN (SELECT doc_id, min_by(quality, quality) AS quality, min_by(toxic, quality) AS toxic FROM labels GROUP BY 1) l USING (doc_id)")
def j3_backfill(s, d):
    docs, labels = table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").withColumn("_o", F.col("quality"))
    return re_.backfill(docs, labels, "doc_id", "_o").select("doc_id", "lang", "quality", "toxic")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j4_total_join(s, d):
    return re_.total_join(table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j5_covered_join(s, d):
    return re_.covered_join(table(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey").select("s_suppkey", "n_name")


@query(f"WITH {QQ} SELECT a.grp, a.lo, count(*) AS n FROM (SELECT DISTINCT grp, lo, blk FROM q) a JOIN (SELECT DISTINCT grp, lo, strict_blk FROM qs) b ON a.grp=b.grp AND a.lo=b.lo GROUP BY ALL")
def j6_composite_join(s, d):
    """Counts of matches on (group, index): both sides are counted by key first, as the product of counts is the match count."""
    a = pairs(s, d).select("grp", "lo", "blk").distinct().groupBy("grp", "lo").agg(F.count("*").alias("na"))
    b = pairs(s, d, "strict_blk").select("grp", "lo", "strict_blk").distinct().groupBy("grp", "lo").agg(F.count("*").alias("nb"))
    return a.join(b, ["grp", "lo"]).select("grp", "lo", (F.col("na") * F.col("nb")).alias("n"))


@query(f"WITH {Q} SELECT blk, lo, round(dy,6) AS dy, round(CASE WHEN sign(dy) <> sign(-dy) THEN dp ELSE -dp END,6) AS dp FROM q")
def j7_sign_alignment(s, d):
    a = pairs(s, d).select("blk", "lo", "dy")
    b = pairs(s, d).select("blk", "lo", (-F.col("dy")).alias("dy2"), (-F.col("dp")).alias("dp"))
    return rounded(re_.sign_aligned(a, b, ["blk", "lo"], "dy", "dy2", "dp").select("blk", "lo", "dy", "dp"))


@query(f"WITH {Q} SELECT blk, lo, hi, round(dy,6) AS dy FROM q")
def j8_adjacent_join(s, d):
    return rounded(ce.adjacent_by_join(ce.collapse(measures(s, d), ["y"]), ["y"]).select("blk", "lo", "hi", F.col("d_y").alias("dy")))


@query(f"WITH {C}, {ALL} SELECT blk, lo, hi, round(dy,6) AS dy FROM ap")
def j9_all_pairs(s, d):
    return rounded(ce.all_pairs(ce.collapse(measures(s, d), ["y"]), ["y"]).select("blk", "lo", "hi", F.col("d_y").alias("dy")))


@query(f"""WITH {M}, o AS (SELECT strict_blk AS blk, row_id, y, row_number() OVER (PARTITION BY strict_blk ORDER BY row_id, y)-1 AS r FROM m), b AS (SELECT blk, count(*) AS n, count(*)*(count(*)-1) AS pairs FROM o GROUP BY 1 HAVING count(*)>1),
t AS (SELECT blk, n, pairs, unnest(range(CASE WHEN pairs <= 96 THEN pairs ELSE 40 END)) AS t FROM b), h AS (SELECT *, ('0x'||substr(md5(concat_ws('|',blk,t)),1,8))::BIGINT AS h FROM t),
d AS (SELECT blk, n, CASE WHEN pairs <= 96 THEN t ELSE h % pairs END AS k, min(CASE WHEN pairs <= 96 THEN h ELSE t END) AS pos FROM h GROUP BY 1,2,3), x AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY pos, k) AS place, k//(n-1) AS a, k%(n-1) AS c FROM d)
SELECT x.blk, p.row_id AS i, q.row_id AS j, round(p.y-q.y,6) AS delta FROM x JOIN o p ON p.blk=x.blk AND p.r=x.a JOIN o q ON q.blk=x.blk AND q.r=x.c+(x.c>=x.a)::INT WHERE place<=12""")
def j10_ordered_pairs(s, d):
    return rounded(ce.ordered_pairs(measures(s, d), "y", 12, "strict_blk", ("row_id", "y")))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE l_returnflag WHEN 'R' THEN 1.0::DOUBLE WHEN 'A' THEN 2.0::DOUBLE END, 0.0::DOUBLE) AS radius FROM lineitem")
def j11_lookup(s, d):
    lookup = s.createDataFrame([("R", 1.0), ("A", 2.0)], "l_returnflag string, r double")
    return table(s, d, "lineitem").join(F.broadcast(lookup), "l_returnflag", "left").select("l_orderkey", "l_linenumber", F.coalesce("r", F.lit(0.0)).alias("radius"))


@query("""WITH dim AS (SELECT p_partkey AS k1, p_brand AS k2, p_retailprice AS v FROM part WHERE p_size <= 10), one AS (SELECT k1, min(v) AS v1 FROM dim GROUP BY 1), two AS (SELECT k2, min(v) AS v2 FROM dim GROUP BY 1)
SELECT p_partkey, round(coalesce(v1,v2),6) AS v, CASE WHEN v1 IS NOT NULL THEN 'k1' WHEN v2 IS NOT NULL THEN 'k2' END AS provenance FROM part LEFT JOIN one ON p_partkey=k1 LEFT JOIN two ON p_brand=k2""")
def j12_fallback_join(s, d):
    part = table(s, d, "part")
    dim = part.filter("p_size <= 10").select(F.col("p_partkey").alias("k1"), F.col("p_brand").alias("k2"), F.col("p_retailprice").alias("v"))
    return rounded(re_.fallback_join(part.select(F.col("p_partkey").alias("k1"), F.col("p_brand").alias("k2")), dim, "k1", "k2", "v").select(F.col("k1").alias("p_partkey"), "v", "provenance"))


@query("SELECT d.doc_id, CASE WHEN lang='en' THEN quality END AS gated, quality AS ungated FROM documents d LEFT JOIN labels l USING (doc_id)")
def j13_gated_join(s, d):
    both = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("lang") == "en", F.col("quality")).alias("gated"), F.col("quality").alias("ungated"))


@query("SELECT concat_ws(':', o_orderstatus, o_orderkey) AS id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1")
def j14_namespaced_join(s, d):
    orders = table(s, d, "orders").select(F.concat_ws(":", "o_orderstatus", "o_orderkey").alias("id"), "o_orderkey")
    return table(s, d, "lineitem").select("l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("id").agg(F.count("*").alias("n"))


PTS = "pt AS (SELECT label AS build_id, vec_id AS i, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


def points(s, d):
    return table(s, d, "embeddings").select(F.col("label").alias("build_id"), F.col("vec_id").alias("i"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))


@query(f"WITH {PTS} SELECT a.build_id, a.i, b.i AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)),6) AS dist FROM pt a JOIN pt b ON a.build_id=b.build_id AND a.i<b.i WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 0.15")
def j15_radius_join(s, d):
    return rounded(re_.radius_join(points(s, d), 0.15))


DIST = f"{PTS}, ds AS (SELECT a.build_id, a.i, b.i AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)),9) AS dist FROM pt a JOIN pt b ON a.build_id=b.build_id AND a.i<>b.i)"


@query(f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY build_id, i ORDER BY dist, j) AS r FROM ds) SELECT DISTINCT build_id, least(i,j) AS i, greatest(i,j) AS j, round(dist,6) AS dist FROM r WHERE r<=4")
def j16_nearest_graph(s, d):
    return rounded(re_.nearest_graph(re_.near_pairs(points(s, d), 4), 4))


@query(f"WITH {QQ} SELECT grp, lo, hi FROM (SELECT DISTINCT grp, lo, hi FROM q) EXCEPT SELECT grp, lo, hi FROM qs")
def j17_anti_join(s, d):
    return pairs(s, d).select("grp", "lo", "hi").distinct().join(pairs(s, d, "strict_blk").select("grp", "lo", "hi").distinct(), ["grp", "lo", "hi"], "left_anti")


@query(f"WITH {M} SELECT row_id, round(avg(y) OVER (PARTITION BY grp),6) AS mean, round(y - avg(y) OVER (PARTITION BY blk),6) AS centred, count(*) OVER (PARTITION BY grp) AS size FROM m")
def w1_w3_group_broadcast(s, d):
    m = with_group(measures(s, d).select("row_id", "grp", "blk", "y"), "grp", {"mean": F.avg("y"), "size": F.count("*")})
    return rounded(me.centred(m, "blk", ["y"]).select("row_id", "mean", F.col("y_c").alias("centred"), "size"))


@query(f"WITH {Q} SELECT blk, lo, round(dy - avg(dy) OVER (PARTITION BY lo),6) AS residual FROM q")
def w4_profile_residual(s, d):
    """Residual from the shared profile: the profile has a row an index, so it is joined, not windowed over a handful of partitions."""
    q = pairs(s, d)
    return rounded(q.join(F.broadcast(q.groupBy("lo").agg(F.avg("dy").alias("shared"))), "lo").select("blk", "lo", (F.col("dy") - F.col("shared")).alias("residual")))


@query(f"WITH {C}, l AS (SELECT blk, idx, lead(idx) OVER w AS nxt, y - lead(y) OVER w AS step FROM c WINDOW w AS (PARTITION BY blk ORDER BY idx)) SELECT blk, idx, round(step,6) AS step FROM l WHERE nxt-idx=1")
def w5_gap_step(s, d):
    return rounded(ce.adjacent(ce.collapse(measures(s, d), ["y"]), ["y"]).select("blk", F.col("lo").alias("idx"), F.col("d_y").alias("step")))


@query(f"WITH {Q}, l AS (SELECT blk, sign(dy) AS s, lag(sign(dy)) OVER (PARTITION BY blk ORDER BY lo) AS b FROM q) SELECT blk, coalesce(sum(CASE WHEN s<>b THEN 1 ELSE 0 END),0)::BIGINT AS changes FROM l GROUP BY blk")
def w6_sign_changes(s, d):
    before = F.lag(F.signum("dy")).over(Window.partitionBy("blk").orderBy("lo"))
    return pairs(s, d).select("blk", (F.signum("dy") != before).alias("t")).groupBy("blk").agg(F.count(F.when(F.col("t"), 1)).alias("changes"))


@query(f"WITH {C}, l AS (SELECT blk, lead(y) OVER (PARTITION BY blk ORDER BY idx) - y AS step FROM c), b AS (SELECT blk, sign(max_by(step, (abs(step), step))) AS way FROM l WHERE step IS NOT NULL GROUP BY blk) SELECT blk, round(avg(CASE WHEN sign(step)<>way THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS non_monotone FROM l JOIN b USING (blk) WHERE step IS NOT NULL GROUP BY blk")
def w7_non_monotone(s, d):
    step = F.lead("y").over(Window.partitionBy("blk").orderBy("idx")) - F.col("y")
    l = ce.collapse(measures(s, d), ["y"]).select("blk", step.alias("step")).filter("step is not null")  # noqa: E741
    b = l.groupBy("blk").agg(F.signum(F.max_by("step", F.struct(F.abs("step"), "step"))).alias("way"), F.count(F.when(F.col("step") > 0, 1)).alias("up"), F.count(F.when(F.col("step") < 0, 1)).alias("down"), F.count("*").alias("n"))
    same = F.when(F.col("way") > 0, F.col("up")).when(F.col("way") < 0, F.col("down")).otherwise(F.col("n") - F.col("up") - F.col("down"))
    return rounded(b.select("blk", ((F.col("n") - same) / F.col("n")).alias("non_monotone")))


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w8_first_row(s, d):
    return re_.first_rows(table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r<=3 ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def w9_capped_top(s, d):
    return re_.capped_top(table(s, d, "part"), "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 3, 40).select("p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_brand, max_by(p_partkey, (p_retailprice, p_partkey)) AS best FROM part GROUP BY 1")
def w10_best_run(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("best"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r = (n-1)//2 + 1")
def w11_middle_anchor(s, d):
    return re_.middle_rows(table(s, d, "part"), ["p_brand"], ["p_size", "p_partkey"]).select("p_brand", "p_partkey")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey)-1 AS r, count(*) OVER () AS n FROM part), t AS (SELECT *, floor(r*10/n)::INT AS stratum FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY r)-1 AS k, count(*) OVER (PARTITION BY stratum) AS m FROM t) SELECT stratum, p_partkey FROM k WHERE floor(k*3/m) <> floor((k-1)*3/m)""")
def w12_decile_pick(s, d):
    return re_.decile_pick(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey").select("stratum", "p_partkey")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part")
def w13_interleave(s, d):
    return re_.interleaved(table(s, d, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


@query("WITH z AS (SELECT p_brand, p_type, count(*) AS size, min(p_partkey) AS member FROM part GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY size DESC, p_type) AS r FROM z) SELECT p_brand, p_type, size, member FROM b WHERE r=1 ORDER BY size DESC, p_brand LIMIT 12")
def w14_representatives(s, d):
    return re_.representatives(table(s, d, "part"), "p_brand", "p_type", "p_partkey", 12)


@query("WITH t AS (SELECT p_partkey, p_brand, p_retailprice/7.0::DOUBLE AS v FROM part) SELECT p_partkey, round(v - avg(v) OVER (PARTITION BY p_brand),6) AS delta, round((v - avg(v) OVER (PARTITION BY p_brand))/nullif(stddev_samp(v) OVER (PARTITION BY p_brand),0),6) AS z, rank() OVER (PARTITION BY p_brand ORDER BY v) AS rnk FROM t")
def w15_family_standing(s, d):
    out = re_.standing(table(s, d, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") / F.lit(7.0)).alias("v")), "p_brand", "v")
    return rounded(out.select("p_partkey", F.col("v_delta").alias("delta"), F.col("v_z").alias("z"), F.col("v_rank").alias("rnk")))


@query("WITH f AS (SELECT p_brand, regr_slope(p_retailprice,p_size) AS slope, regr_intercept(p_retailprice,p_size) AS b, avg(p_retailprice) AS mean FROM part GROUP BY 1) SELECT p_partkey, round(slope,6) AS slope, round(mean,6) AS mean, round(b+slope*p_size,6) AS fitted FROM part JOIN f USING (p_brand)")
def w16_family_line(s, d):
    return rounded(re_.family_line(table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_brand", "p_size", "p_retailprice").select("p_partkey", "slope", "mean", "fitted"))


@query("SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_size) + avg(p_retailprice) OVER (),6) AS v FROM part")
def w17_main_effect(s, d):
    return rounded(re_.without_main_effect(table(s, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("v")), "p_size", "v").select("p_partkey", "v"))


@query(f"WITH {M} SELECT row_id, round(avg(l_discount) OVER (PARTITION BY blk),6) AS l_discount, round(avg(l_tax) OVER (PARTITION BY blk),6) AS l_tax FROM m")
def w18_block_means(s, d):
    m = measures(s, d).select("row_id", "blk", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return rounded(with_group(m, "blk", {"l_discount": F.avg("a"), "l_tax": F.avg("b")}).select("row_id", "l_discount", "l_tax"))


@query("SELECT p_brand, max(CASE WHEN p_size>5 THEN p_retailprice END) AS top FROM part GROUP BY 1 ORDER BY top DESC NULLS LAST, p_brand")
def l1_nulls_last(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_size") > 5, F.col("p_retailprice"))).alias("top")).orderBy(F.desc_nulls_last("top"), "p_brand")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def l2_leaderboard(s, d):
    return table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("SELECT max_by(p_partkey, (p_retailprice, p_partkey)) AS by_price, max_by(p_partkey, (p_size, p_partkey)) AS by_size, max_by(p_partkey, (p_retailprice, p_partkey)) = max_by(p_partkey, (p_size, p_partkey)) AS agree FROM part")
def l3_two_argmaxes(s, d):
    a, b = (F.max_by("p_partkey", F.struct(c, "p_partkey")) for c in ("p_retailprice", "p_size"))
    return table(s, d, "part").agg(a.alias("by_price"), b.alias("by_size"), (a == b).alias("agree"))


@query("WITH g AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY 1) SELECT p_brand, round(v,6) AS v, round(v - (SELECT v FROM g WHERE p_brand = (SELECT min(p_brand) FROM part)),6) AS delta FROM g")
def l4_delta_to_reference(s, d):
    by = table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    return rounded(re_.delta_to_reference(by, "p_brand", by.agg(F.min("p_brand")).first()[0], "v"))


@query("SELECT unnest(['l_tax','l_returnflag']) AS name")
def l5_varying_columns(s, d):
    items = table(s, d, "lineitem").withColumn("constant", F.lit(1))
    return s.createDataFrame([(c,) for c in re_.varying_columns(items, ["l_tax", "l_returnflag", "constant"])], "name string")


@query("SELECT 'c' AS kind, c_custkey AS key, c_mktsegment AS seg, NULL::VARCHAR AS extra FROM customer UNION ALL SELECT 's', s_suppkey, NULL, s_name FROM supplier")
def u1_union_by_name(s, d):
    a = table(s, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"))
    b = table(s, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT 'only_documents' AS part, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def u2_id_sets(s, d):
    a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id")
    return a.subtract(b).agg(F.lit("only_documents").alias("part"), F.count("*").alias("n")).unionAll(a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")))


@query(f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY build_id, i ORDER BY dist, j) AS r FROM ds), a AS (SELECT DISTINCT least(i,j) AS i, greatest(i,j) AS j FROM r WHERE r<=4), b AS (SELECT DISTINCT least(i,j) AS i, greatest(i,j) AS j FROM r WHERE r<=6), f AS (SELECT a.i AS ai, b.i AS bi FROM a FULL JOIN b ON a.i=b.i AND a.j=b.j) SELECT count(ai) AS left_edges, count(bi) AS right_edges, count(*) FILTER (WHERE ai IS NULL OR bi IS NULL) AS different, round(avg(CASE WHEN ai IS NULL OR bi IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),6) AS share FROM f")
def u3_edge_difference(s, d):
    ds = stored(re_.near_pairs(points(s, d), 6))
    return rounded(re_.edge_difference(re_.nearest_graph(ds, 4), re_.nearest_graph(ds, 6), ["i", "j"]))


@query("SELECT 0::BIGINT AS shared, 0::BIGINT AS missing, 0::BIGINT AS foreign_keys")
def u4_split_check(s, d):
    cust = table(s, d, "customer").select("c_custkey")
    parts = cust.select("c_custkey", (hash32("c_custkey") % 3).alias("part"))
    return re_.split_check(parts, "part", "c_custkey", cust).withColumnRenamed("foreign", "foreign_keys")


@query(f"WITH {C}, x AS (SELECT blk, " + ", ".join(f"max(CASE WHEN idx={i} THEN y END) AS i{i}" for i in (1, 2, 3, 4, 6, 7, 8)) + " FROM c GROUP BY blk) SELECT blk, " + ", ".join(f"round(i{i},6) AS i{i}" for i in (1, 2, 3, 4, 6, 7, 8)) + " FROM x WHERE " + " AND ".join(f"i{i} IS NOT NULL" for i in (1, 2, 3, 4, 6, 7, 8)))
def u5_block_matrix(s, d):
    return rounded(re_.block_matrix(ce.collapse(measures(s, d), ["y"]), "blk", [1, 2, 3, 4, 6, 7, 8], "y"))


@query("SELECT event_id, round(abs(value),6) AS a, round(sqrt(abs(value)),6) AS r, round(ln(1+abs(value)),6) AS l, sign(value)::DOUBLE AS s, round(greatest(-1.0, least(1.0, value)),6) AS c, round(atan(value),6) AS t FROM events")
def c1_math(s, d):
    return rounded(table(s, d, "events").select("event_id", F.abs("value").alias("a"), F.sqrt(F.abs("value")).alias("r"), F.log1p(F.abs("value")).alias("l"), F.signum("value").alias("s"), clip("value", -1.0, 1.0).alias("c"), F.atan("value").alias("t")))


@query("SELECT p_partkey, upper(trim(p_name)) AS u, string_split(p_name,' ')[1] AS w, starts_with(p_type,'PROMO') AS promo, regexp_replace(p_brand,'[0-9]+','#') AS b, ((length(p_name)-length(replace(p_name,'e','')))/1)::INT AS e FROM part")
def c2_strings(s, d):
    return table(s, d, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("u"), F.split("p_name", " ", 2)[0].alias("w"), F.col("p_type").startswith("PROMO").alias("promo"), F.regexp_replace("p_brand", "[0-9]+", "#").alias("b"), occurrences("p_name", "e").alias("e"))


@query("SELECT o_orderkey, substr(sha256(concat_ws('|', o_custkey, o_orderpriority)),1,20) AS h FROM orders")
def c3_hash_keys(s, d):
    return table(s, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256), 1, 20).alias("h"))


@query("SELECT l_orderkey, l_linenumber, (round(l_discount,2)*100)::INT || 'e-2' AS k FROM lineitem")
def c4_number_keys(s, d):
    """Numbers in keys go through rounded integers: number formatting differs between engines."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat((F.round("l_discount", 2) * 100).cast("int").cast("string"), F.lit("e-2")).alias("k"))


@query("SELECT event_id, coalesce(json_extract_string(props,'$.k')::INT, -1) AS k, coalesce(json_extract_string(props,'$.missing'),'none') AS other FROM events")
def c5_json(s, d):
    return table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("SELECT p_partkey, len(list_distinct(string_split(p_name,' '))) AS n, list_sort(list_distinct(string_split(p_name,' ')))[1] AS first, coalesce(string_split(p_name,' ')[9], 'none') AS ninth FROM part")
def c6_arrays(s, d):
    w = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", F.size(F.array_distinct(w)).cast("long").alias("n"), F.sort_array(F.array_distinct(w))[0].alias("first"), F.coalesce(F.try_element_at(w, F.lit(9)), F.lit("none")).alias("ninth"))


@query("SELECT doc_id, try_cast(substr(text,1,1) AS DOUBLE) AS v FROM documents")
def c7_try_cast(s, d):
    return table(s, d, "documents").select("doc_id", F.substring("text", 1, 1).try_cast("double").alias("v"))


@query("SELECT d.doc_id, coalesce(l.quality, l.toxic, -1) AS v FROM documents d LEFT JOIN labels l USING (doc_id)")
def c8_nulls(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("v"))


@query("SELECT p_partkey, abs(p_size/7.0::DOUBLE - 3.5::DOUBLE) AS tetrad, p_size >= 25 AS half, CASE WHEN p_size > 40 THEN 8 ELSE 9 END AS cn FROM part")
def c9_constants(s, d):
    return table(s, d, "part").select("p_partkey", F.abs(F.col("p_size") / F.lit(7.0) - 3.5).alias("tetrad"), (F.col("p_size") >= 25).alias("half"), F.when(F.col("p_size") > 40, 8).otherwise(9).alias("cn"))


@query("SELECT p_type, CASE WHEN starts_with(p_type,'PROMO B') THEN 'promo_b' WHEN starts_with(p_type,'PROMO') THEN 'promo' WHEN starts_with(p_type,'S') THEN 's' ELSE 'other' END AS block, count(*) AS n FROM part GROUP BY 1,2")
def c11_prefix_class(s, d):
    return table(s, d, "part").groupBy("p_type", first_prefix("p_type", [("PROMO B", "promo_b"), ("PROMO", "promo"), ("S", "s")], "other").alias("block")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, (length(text)-length(replace(text,'the','')))//3 AS n_the, (length(text)-length(replace(text,'en','')))//2 AS n_en, ((length(text)-length(replace(text,'the','')))//3)*n_chars AS cross_term FROM documents")
def c12_counted_substrings(s, d):
    n = occurrences("text", "the").cast("long")
    return table(s, d, "documents").select("doc_id", n.alias("n_the"), occurrences("text", "en").cast("long").alias("n_en"), (n * F.col("n_chars")).alias("cross_term"))
