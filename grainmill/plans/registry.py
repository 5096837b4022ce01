"""Where queries and their SQL are registered, and the measurement view that most of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..operators.roles import Roles, bind

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives its rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The index that never occurs, so that 4 and 6 are not neighbours: line numbers from it on count one more.
MISSING = 5


def line_items(spark: SparkSession, sf_dir: str) -> int:
    """Number of line items, from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def measures(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Line items as measurements: customers are groups, customer-years coarse blocks, orders exact blocks, line numbers the index. keep names more columns of line items."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = line_items(spark, sf_dir)
    both = spread(items, n, "l_orderkey").join(spread(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("o_custkey").cast("string")
    roles = Roles(
        row_id=F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")),
        grp=key,
        blk=F.concat_ws("||", key, F.year("o_orderdate").cast("string")),
        strict_blk=F.col("l_orderkey").cast("string"),
        idx=F.col("l_linenumber") + (F.col("l_linenumber") >= MISSING).cast("int"),
        values={
            "y": F.log("l_extendedprice"),
            "p": F.log("l_quantity") + F.lit(7.2),
            "p2": F.lit(0.6) * F.log("l_quantity") + F.lit(8.4) + F.col("l_tax"),
            "p3": F.lit(10.2) + F.lit(2.0) * F.col("l_discount") - F.col("l_tax") + F.lit(0.05) * F.col("l_linenumber"),
        },
    )
    return bind(both, roles, ("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", *keep))


#: The same view for the SQL, and the cells and pairs of its coarse (c, q) and exact (cs, qs) blocks.
M = """m AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS row_id, o_custkey::VARCHAR AS grp,
         o_custkey || '||' || year(o_orderdate) AS blk, l_orderkey::VARCHAR AS strict_blk, (l_linenumber + (l_linenumber >= 5)::INT)::INT AS idx,
         ln(l_extendedprice) AS y, ln(l_quantity) + 7.2::DOUBLE AS p, 0.6::DOUBLE * ln(l_quantity) + 8.4::DOUBLE + l_tax AS p2,
         10.2::DOUBLE + 2.0::DOUBLE * l_discount - l_tax + 0.05::DOUBLE * l_linenumber AS p3,
         l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _cells(name: str, block: str) -> str:
    return f"{name} AS (SELECT grp, {block}, idx, avg(y) AS y, avg(p) AS p, avg(p2) AS p2, avg(p3) AS p3 FROM m GROUP BY ALL)"


def _pairs(name: str, cells: str, block: str) -> str:
    return f"""{name} AS (SELECT a.grp, a.{block}, a.idx AS lo, b.idx AS hi, a.y - b.y AS dy, a.p - b.p AS dp, a.p2 - b.p2 AS dp2, a.p3 - b.p3 AS dp3
  FROM {cells} a JOIN {cells} b ON a.{block} = b.{block} AND b.idx = a.idx + 1)"""


C = M + ",\n" + _cells("c", "blk")
Q = C + ",\n" + _pairs("q", "c", "blk")
QS = M + ",\n" + _cells("cs", "strict_blk") + ",\n" + _pairs("qs", "cs", "strict_blk")
QQ = Q + ",\n" + _cells("cs", "strict_blk") + ",\n" + _pairs("qs", "cs", "strict_blk")
VALUES = ["y", "p", "p2", "p3"]


def pairs(spark: SparkSession, sf_dir: str, block: str = "blk") -> DataFrame:
    """grp, block, lo, hi, dy, dp, dp2, dp3 of the adjacent pairs."""
    from ..operators.cells import adjacent, collapse

    out = adjacent(collapse(measures(spark, sf_dir), VALUES, block, rows=line_items(spark, sf_dir)), VALUES, block)
    return out.withColumnsRenamed({f"d_{v}": f"d{v}" for v in VALUES})
