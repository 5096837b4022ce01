"""Readers and writers. All files are read and written through Spark, so any store that Spark knows will do."""

from __future__ import annotations

import atexit
import contextlib
import io
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- scans


def scan(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Parquet files, directories or globs; differing schemas are merged by name. None found is an error."""
    paths = [path] if isinstance(path, str) else path
    if not paths:
        raise FileNotFoundError("no parquet path given")
    df = spark.read.parquet(paths[0])
    for p in paths[1:]:
        df = df.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a given schema: ids such as "001234" stay as they are. An empty file gives no rows."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def scan_csvs(spark: SparkSession, paths: list[str], schema: str) -> tuple[DataFrame, list[str]]:
    """(rows of all files, those of the given paths that were empty)."""
    df = scan_csv(spark, paths, schema).withColumn("_file", F.input_file_name())  # type: ignore[arg-type]
    given = F.array(*(F.struct(F.lit(len(p)).alias("n"), F.lit(p).alias("p")) for p in paths))
    of = F.array_max(F.filter(given, lambda g: F.contains(F.col("_file"), F.regexp_replace(g["p"], "^[a-z]+:/*|/$", ""))))["p"]
    names = {r["_p"] for r in df.select(of.alias("_p")).distinct().collect()}  # as many as the caller gave
    return df.drop("_file"), [p for p in paths if p not in names]


REGISTRY = "spec struct<preset:string,model:string,seed:int>, key string, status string, metrics struct<r2:double,mae:double>, params map<string,string>, error string"


def registry(lines: DataFrame, schema: str = REGISTRY, text: str = "value") -> DataFrame:
    """Rows of JSON-lines text with status ok: spec and metrics flattened, params kept as JSON; blank and malformed lines go."""
    parsed = lines.filter(F.trim(text) != "").select(F.from_json(text, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r is not null and r._bad is null and r.status = 'ok'")
    return good.select("r.spec.*", "r.key", "r.metrics.*", F.to_json("r.params").alias("params"))


def scan_registry(spark: SparkSession, path: str, schema: str = REGISTRY) -> DataFrame:
    return registry(spark.read.text(path), schema)


def scan_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records of a directory of one-record JSON files, names of the files that cannot be read)."""
    text = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    df = text.select("_file", F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return df.filter(~bad).select("r.*").drop("_bad"), df.filter(bad).select(F.element_at(F.split("_file", "/"), -1).alias("file"))


def nested_records(df: DataFrame, records: str, keys: list[str], values: list[str], ok: str = "ok") -> DataFrame:
    """Entries of an array of records that are ok; duplicates by key averaged."""
    rows = df.select(*[c for c in df.columns if c != records], F.explode(records).alias("_r")).filter(F.col(f"_r.{ok}"))
    pick = lambda c: F.col(c) if c in df.columns and c != records else F.col(f"_r.{c}")
    return rows.select(*(pick(c).alias(c) for c in [*keys, *values])).groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def stem(path: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def paired_runs(runs: DataFrame, oofs: DataFrame, path: str = "path", prefixes: tuple[str, str] = ("run_", "oof_")) -> DataFrame:
    """Runs whose prediction file of the same stem exists; others are skipped."""
    a = runs.withColumn("_stem", F.regexp_replace(stem(F.col(path)), f"^{prefixes[0]}", ""))
    b = oofs.select(F.regexp_replace(stem(F.col(path)), f"^{prefixes[1]}", "").alias("_stem"), F.col(path).alias("oof_path")).groupBy("_stem").agg(F.min("oof_path").alias("oof_path"))
    return a.join(b, "_stem").drop("_stem")


def xyz(df: DataFrame, text: str = "value") -> DataFrame:
    """natoms, props (map) and atoms (symbol, x, y, z, charge) of XYZ text, plain or extended; other columns stay.

    An extended header names its columns in Properties; charge is the column of that name, null without it. Values in quotes may hold spaces."""
    lines = F.split(F.col(text), "\r?\n")
    head = F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))
    pairs = F.regexp_extract_all(head, F.lit(r"(\w+)=(\"[^\"]*\"|\S+)"), F.lit(0))
    props = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^\w+=", ""), '^"|"$', "").alias("v")))))
    natoms = F.trim(lines[0]).try_cast("int")
    # Of Properties=name:type:count..., the place of charge is the sum of the counts before it.
    spec = F.split(F.coalesce(F.try_element_at(props, F.lit("Properties")), F.lit("species:S:1:pos:R:3")), ":")
    fields = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(spec) / 3).cast("int"))), lambda k: F.struct(F.coalesce(F.try_element_at(spec, 3 * k - 2), F.lit("")).alias("name"), F.coalesce(F.try_element_at(spec, 3 * k).try_cast("int"), F.lit(1)).alias("n")))
    state = F.aggregate(fields, F.struct(F.lit(1).alias("at"), F.lit(None).cast("int").alias("charge")), lambda a, f: F.struct((a["at"] + f["n"]).alias("at"), F.when(f["name"] == "charge", a["at"]).otherwise(a["charge"]).alias("charge")))
    out = df.withColumns({"_lines": lines, "natoms": natoms, "props": props, "_charge": state["charge"]})
    rows = F.transform(F.slice("_lines", F.lit(3), F.coalesce("natoms", F.lit(0))), lambda x: F.split(F.trim(x), r"\s+"))
    number = lambda w, k: F.try_element_at(w, k).try_cast("double")
    atoms = F.transform(rows, lambda w: F.struct(F.try_element_at(w, F.lit(1)).alias("symbol"), *(number(w, F.lit(k)).alias(c) for k, c in ((2, "x"), (3, "y"), (4, "z"))), F.when(F.col("_charge").isNotNull(), number(w, F.coalesce("_charge", F.lit(1)))).alias("charge")))
    return out.withColumn("atoms", atoms).drop("_lines", "_charge")


def scan_xyz(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return xyz(df).drop("value")


def mol2(df: DataFrame, text: str = "value") -> DataFrame:
    """sections (map of name to its lines) and atoms (name, x, y, z, type) of MOL2 text."""
    body = lambda p: F.filter(F.slice(F.split(p, "\r?\n"), 2, 1 << 30), lambda x: F.trim(x) != "")
    # the text before the first mark is no section; sections of one name are kept as the first
    entries = F.transform(F.slice(F.split(F.col(text), "@<TRIPOS>"), 2, 1 << 30), lambda p: F.struct(F.trim(F.split(p, "\r?\n")[0]).alias("k"), body(p).alias("v")))
    firsts = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, F.lit(1), k), lambda o: o["k"] == e["k"]))
    out = df.withColumn("sections", F.map_from_entries(firsts))
    words = F.transform(F.coalesce(F.try_element_at("sections", F.lit("ATOM")), F.array().cast("array<string>")), lambda x: F.split(F.trim(x), r"\s+"))
    atoms = F.transform(words, lambda w: F.struct(F.try_element_at(w, F.lit(2)).alias("name"), *(F.try_element_at(w, F.lit(k)).try_cast("double").alias(c) for k, c in ((3, "x"), (4, "y"), (5, "z"))), F.try_element_at(w, F.lit(6)).alias("type")))
    return out.withColumn("atoms", atoms)


def scan_mol2(spark: SparkSession, path: str) -> DataFrame:
    return mol2(spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())).drop("value")


# The marks that the external program prints.
TOTAL_ENERGY = r"TOTAL ENERGY\s+(-?\d+\.\d+)"
GRADIENT_NORM = r"GRADIENT NORM\s+(\d+\.\d+)"
CONVERGED = "GEOMETRY OPTIMIZATION CONVERGED"
CYCLES = r"CONVERGED AFTER\s+(\d+)"
ORBITAL = r"(-?\d+\.\d+)\s+\({}\)"


def log_scrape(df: DataFrame, text: str = "value") -> DataFrame:
    """energy and gradient (the last printed), converged, cycles, homo and lumo of program logs; null where not printed."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), F.lit(-1))
    return df.withColumns({"energy": last(TOTAL_ENERGY).try_cast("double"), "gradient": last(GRADIENT_NORM).try_cast("double"), "converged": F.contains(F.col(text), F.lit(CONVERGED)), "cycles": last(CYCLES).try_cast("int"), "homo": last(ORBITAL.format("HOMO")).try_cast("double"), "lumo": last(ORBITAL.format("LUMO")).try_cast("double")})


def first_by_name(listing: DataFrame, path: str = "path", excluded: str | None = None) -> DataFrame:
    """Of each file name the first path in order, outside an excluded sub-tree."""
    df = listing.filter(~F.contains(path, F.lit(excluded))) if excluded else listing
    return df.groupBy(F.element_at(F.split(path, "/"), -1).alias("name")).agg(F.min(path).alias("path"))


def resolve(candidates: DataFrame, listing: DataFrame, key: str, path: str = "path", priority: str = "priority") -> DataFrame:
    """Of each key the candidate path of least priority number that exists; null when none does."""
    hit = candidates.join(listing.select(path).distinct(), path, "left_semi")
    best = hit.groupBy(key).agg(F.min_by(path, F.struct(priority, path)).alias(path))
    return candidates.select(key).distinct().join(best, key, "left")


_ARRAYS = "path string, name string, segment long, position long, value double"


def scan_arrays(spark: SparkSession, path: str, values: str, ptr: str) -> DataFrame:
    """path, name, segment, position, value of NPZ files that hold a flat array and, in CSR manner, where its segments begin; an array is one row in memory."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    flat, begin = held[values], held[ptr].astype(np.int64)
                size = np.diff(begin)
                segment = np.repeat(np.arange(len(size)), size)
                inside = np.arange(begin[0], begin[-1])
                yield pd.DataFrame({"path": where, "name": values, "segment": segment, "position": inside - begin[segment], "value": flat[inside].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _ARRAYS)


# ---- sinks


def scratch(spark: SparkSession) -> str:
    """A path of its own in the folder that the driver and executors share, removed when the driver ends; where none is named, on a local master only, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="grainmill-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{named}/grainmill-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            fs, p = _fs(spark, path)
            fs.delete(p, True)

    atexit.register(remove)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table at scratch(): what several plans read is computed once, and survives a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One file of bytes, through Spark's own file systems."""
    fs, p = _fs(spark, path)
    out = fs.create(p)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_parquet(df: DataFrame, path: str) -> None:
    """Writes beside the target, then renames: readers see the old table or the new one, and df may read the old one."""
    spark = df.sparkSession
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(target):
        fs.rename(target, jpath(old))
    if not fs.rename(jpath(staged), target):
        raise OSError(f"cannot rename {staged} to {path}")
    fs.delete(jpath(old), True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with headers, as many as df has: a report that is small comes out as one."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def extend_table(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The CSV table at path with rows after it, columns by name; written in its place."""
    fs, target = _fs(spark, path)
    out = rows
    if fs.exists(target):
        held = spark.read.option("header", True).csv(path)
        out = held.unionByName(rows.select(*(F.col(c).cast("string") for c in rows.columns)), allowMissingColumns=True)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    write_csv(out, staged)
    fs.delete(target, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target)
    return spark.read.option("header", True).csv(path)


def freeze(df: DataFrame, path: str) -> None:
    """Writes once; a second time is an error."""
    df.write.mode("errorifexists").parquet(path)


def xyz_text(df: DataFrame, key: str, atoms: str = "atoms", header: str = "header") -> DataFrame:
    """key and value, the extended-XYZ text of an array of atoms with charges."""
    line = F.transform(atoms, lambda a: F.format_string("%-2s %14.8f %14.8f %14.8f %12.6f", a["symbol"], a["x"], a["y"], a["z"], F.coalesce(a["charge"], F.lit(0.0))))
    return df.select(key, F.concat_ws("\n", F.size(atoms).cast("string"), F.concat_ws(" ", F.lit("Properties=species:S:1:pos:R:3:charge:R:1"), F.col(header)), F.array_join(line, "\n")).alias("value"))


def markdown(df: DataFrame, columns: list[str], digits: int = 4, most: int = 10_000) -> str:
    """A report table, missing values as empty cells. A table of more than `most` rows is no report and an error."""
    cell = lambda v: "" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    rows = [[cell(r[c]) for c in columns] for r in df.select(*columns).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a markdown table")
    return "\n".join("| " + " | ".join(x) + " |" for x in [columns, ["---"] * len(columns), *rows])


def first_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
