"""Every query with SQL against DuckDB on the smallest tables, and the rest for rows."""

import datetime
import math

import duckdb
import pytest

from grainmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.SQL))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if v is None or isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if math.isnan(float(v)) else round(float(v), 5) + 0.0


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a))


def unmatched(pairs):
    """What is left of rows that differ in order when each is paired with any row of the other side that is near it."""
    want = [y for _, y in pairs]
    left = []
    for x, _ in pairs:
        k = next((k for k, y in enumerate(want) if all(map(near, x, y))), None)
        if k is None:
            left.append(x)
        else:
            want.pop(k)
    return left


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[k]) for k in at) for r in cursor.fetchall()]
    assert len(got) == len(want)
    order = lambda r: [(x is None, isinstance(x, str), 0 if x is None else x) for x in r]
    keys = sorted(range(len(columns)), key=lambda k: isinstance(next((r[k] for r in want if r[k] is not None), 0), float))
    sort = lambda rows: sorted(rows, key=lambda r: order([round(r[k], 3) if isinstance(r[k], float) else r[k] for k in keys]))
    bad = [(x, y) for x, y in zip(sort(got), sort(want), strict=True) if not all(map(near, x, y))]
    bad = unmatched(bad)  # rows whose keys tie after rounding may change places
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_sql_has_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__

    assert set(catalog.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
