"""Queries of readers and writers: each writes a table to the shared folder and reads it back."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from ..operators import registry as xr
from ..sources import files
from .registry import query, table
from .structures import AT, atoms


def total(c):
    return F.round(F.aggregate(F.transform("atoms", lambda a: a[c]), F.lit(0.0), lambda a, v: a + v), 3)


@query("SELECT lpad(c_custkey::VARCHAR, 9, '0') AS id, c_nationkey, round(c_acctbal,2) AS balance FROM customer")
def s3_csv_scan(s, d):
    """Ids keep their leading zeros."""
    path = files.scratch(s)
    files.write_csv(table(s, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id"), "c_nationkey", F.round("c_acctbal", 2).alias("balance")), path)
    return files.scan_csv(s, path, "id string, c_nationkey int, balance double")


@query("SELECT 'full' AS file, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier UNION ALL SELECT 'empty', 0, NULL")
def s4_csv_with_empty(s, d):
    path = files.scratch(s)
    suppliers = table(s, d, "supplier").select("s_suppkey")
    files.write_csv(suppliers, f"{path}/full")
    suppliers.filter("false").select(F.col("s_suppkey").cast("string")).write.text(f"{path}/empty")
    rows, empty = files.scan_csvs(s, [f"{path}/full", f"{path}/empty"], "s_suppkey long")
    none = s.createDataFrame([(p.rsplit("/", 1)[-1], 0, None) for p in empty], "file string, n long, keys long")
    return rows.agg(F.lit("full").alias("file"), F.count("*").alias("n"), F.sum("s_suppkey").alias("keys")).unionByName(none)


@query("SELECT n_nationkey AS key, n_name AS name, n_nationkey % 7 <> 3 AS readable FROM nation WHERE n_nationkey % 7 <> 3 UNION ALL SELECT NULL, NULL, false FROM nation WHERE n_nationkey % 7 = 3")
def s6_record_files(s, d):
    """A file a record; those cut short are told, not lost."""
    path = files.scratch(s)
    n = table(s, d, "nation")
    line = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))
    n.select(F.when(F.col("n_nationkey") % 7 == 3, F.substring(line, 1, 9)).otherwise(line)).write.option("maxRecordsPerFile", 1).text(path)
    good, bad = files.scan_records(s, path, "key int, name string")
    return good.withColumn("readable", F.lit(True)).unionByName(bad.select(F.lit(False).alias("readable")), allowMissingColumns=True)


@query("SELECT 'runs/' || (o_orderkey % 5) || '/run_' || o_orderkey || '.json' AS path, 'oof/oof_' || o_orderkey || '.parquet' AS oof_path FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0")
def s8_paired_runs(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    runs = o.filter("o_orderkey % 3 <> 0").select(F.concat(F.lit("runs/"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/run_"), key, F.lit(".json")).alias("path"))
    oofs = o.filter("o_orderkey % 2 = 0").select(F.concat(F.lit("oof/oof_"), key, F.lit(".parquet")).alias("path"))
    return files.paired_runs(runs, oofs).select("path", "oof_path")


@query("SELECT n_regionkey::BIGINT AS segment, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position, n_nationkey::DOUBLE AS value FROM nation")
def s9_array_assets(s, d):
    """Nations by region as one flat array and the places where regions begin."""
    rows = sorted((r["n_regionkey"], r["n_nationkey"]) for r in table(s, d, "nation").collect())
    region = np.array([r[0] for r in rows])
    out = io.BytesIO()
    np.savez(out, values=np.array([r[1] for r in rows], np.float32), ptr=np.searchsorted(region, np.arange(region.max() + 2)))
    path = files.scratch(s)
    files.put_bytes(s, f"{path}/nations.npz", out.getvalue())
    return files.scan_arrays(s, path, "values", "ptr").select("segment", "position", "value")


def _plain(a):
    line = F.format_string("%s %.6f %.6f %.6f", "symbol", "x", "y", "z")
    return a.groupBy("build_id").agg(F.concat_ws("\n", F.count("*").cast("string"), F.concat(F.lit("build="), F.col("build_id").cast("string")), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("value"))


@query(f"WITH {AT} SELECT build_id::VARCHAR AS build, count(*)::INT AS natoms, round(sum(round(x,6)),3) AS sx, round(sum(round(z,6)),3) AS sz FROM a GROUP BY 1")
def s11_plain_xyz(s, d):
    """A file a structure, without charges."""
    path = files.scratch(s)
    _plain(atoms(s, d)).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.scan_xyz(s, path).select(F.col("props")["build"].alias("build"), "natoms", total("x").alias("sx"), total("z").alias("sz"))


@query(f"WITH {AT} SELECT build_id::VARCHAR AS build, count(*)::INT AS natoms, round(sum(round(y,6)),3) AS sy, sum((symbol='N')::INT)::INT AS nitrogen FROM a GROUP BY 1")
def s12_mol2(s, d):
    path = files.scratch(s)
    line = F.format_string("%d %s %.6f %.6f %.6f %s", F.col("i"), "symbol", "x", "y", "z", "symbol")
    text = atoms(s, d).groupBy("build_id").agg(F.concat_ws("\n", F.lit("@<TRIPOS>MOLECULE"), F.col("build_id").cast("string"), F.lit("@<TRIPOS>ATOM"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("@<TRIPOS>BOND")).alias("value"))
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    nitrogen = F.size(F.filter("atoms", lambda a: a["type"] == "N")).alias("nitrogen")
    return files.scan_mol2(s, path).select(F.trim(F.col("sections")["MOLECULE"][0]).alias("build"), F.size("atoms").alias("natoms"), total("y").alias("sy"), nitrogen)


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_nationkey > 3 THEN s_nationkey::VARCHAR END AS nation FROM supplier")
def k1_csv_sink(s, d):
    """What a reader without a schema sees: text, and nulls as empty cells."""
    path = files.scratch(s)
    files.write_csv(table(s, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") > 3, F.col("s_nationkey")).alias("nation")), path)
    return s.read.option("header", True).csv(path)


@query("SELECT s_suppkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def k2_atomic_replace(s, d):
    """A table replaced by rows that are read from it."""
    path = files.scratch(s)
    files.replace_parquet(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), path)
    files.replace_parquet(s.read.parquet(path).filter("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), path)
    return s.read.parquet(path)


@query("SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events")
def k3_jsonl_append(s, d):
    """One line an experiment, appended by two runs, errors included."""
    path = files.scratch(s)
    e = table(s, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 == 0, "failed").otherwise("ok").alias("status"))
    for k in (0, 1):
        files.append_jsonl(e.filter(F.col("event_id") % 2 == k), path)
    return s.read.schema("event_id long, event_type string, status string").json(path)


@query("SELECT r_regionkey, r_name, true AS refused FROM region")
def k5_freeze_once(s, d):
    """The second write is refused and changes nothing."""
    from pyspark.errors import AnalysisException

    path = files.scratch(s)
    files.freeze(table(s, d, "region"), path)
    try:
        files.freeze(table(s, d, "region").limit(1), path)
        refused = False
    except AnalysisException:
        refused = True
    return s.read.parquet(path).withColumn("refused", F.lit(refused))


@query(f"WITH {AT} SELECT build_id::VARCHAR AS build, count(*)::INT AS natoms, round(sum(x),3) AS sx, round(sum(charge),3) AS sq FROM a GROUP BY 1")
def k6_extended_xyz_sink(s, d):
    """Structures with charges, a file each, read again."""
    path = files.scratch(s)
    held = atoms(s, d).groupBy("build_id").agg(F.sort_array(F.collect_list(F.struct("i", "symbol", "x", "y", "z", "charge"))).alias("atoms"))
    text = files.xyz_text(held.withColumn("header", F.concat(F.lit("build="), F.col("build_id").cast("string"))), "build_id")
    text.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.scan_xyz(s, path).select(F.col("props")["build"].alias("build"), "natoms", total("x").alias("sx"), total("charge").alias("sq"))


@query("""WITH t AS (SELECT r_name, count(n_nationkey) AS nations, CASE WHEN r_name <> (SELECT min(r_name) FROM region) THEN avg(n_nationkey) END AS mean FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)
SELECT '| r_name | nations | mean |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || nations || ' | ' || coalesce(printf('%.4f', mean), '') || ' |', chr(10) ORDER BY r_name) AS report FROM t""")
def k7_markdown(s, d):
    both = table(s, d, "region").join(table(s, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"), F.avg("n_nationkey").alias("mean"))
    least = table(s, d, "region").agg(F.min("r_name").alias("_least"))
    report = files.markdown(both.crossJoin(F.broadcast(least)).withColumn("mean", F.when(F.col("r_name") != F.col("_least"), F.col("mean"))).orderBy("r_name"), ["r_name", "nations", "mean"])
    return s.createDataFrame([(report,)], "report string")


@query("SELECT r_name, r_regionkey % 2 = 0 AS kept FROM region")
def x8_append_only(s, d):
    """A document of all regions' names with lines put between the old ones, or with one old line gone."""
    names = sorted(r["r_name"] for r in table(s, d, "region").collect())
    old = "\n".join(names)
    longer = "\n".join(x for n in names for x in (n, "more"))
    new = {r["r_name"]: longer if r["r_regionkey"] % 2 == 0 else longer.replace(r["r_name"], "") for r in table(s, d, "region").collect()}
    return s.createDataFrame([(n, xr.only_appended(old, new[n])) for n in names], "r_name string, kept boolean")


@query("SELECT 'same' AS name, true AS unchanged UNION ALL SELECT 'order', false UNION ALL SELECT 'column', false")
def x10_preset_guard(s, d):
    """Blocks of the line items' columns against a cached list."""
    now = table(s, d, "lineitem").columns
    cached = {"same": now, "order": now[::-1], "column": now[:-1]}
    out = []
    for name in cached:
        try:
            xr.unchanged_preset({name: now}, cached, name)
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return s.createDataFrame(out, "name string, unchanged boolean")
