"""Importance resampling against a plain version of its rule."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from grainmill.llm import importance, queries

from .helpers import SCHEMA, empty, hostile, rows

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text, runs=1):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(g.encode()) % 10000 for g in grams], len(words)


def plain(data, target, runs=1):
    """(doc_id, n_features, weight, score, whether the words are enough) of each row, and the number of rows to draw."""
    corpus = [(i, *features(t, runs)) for i, t in data]
    s, t = collections.Counter(), collections.Counter()
    for _, f, _ in corpus:
        s.update(f)
    for text in target:
        t.update(features(text, runs)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    out = []
    for i, f, n in corpus:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    return out, 10 * sum(x[4] for x in out) // 100


def check(got, data, target, runs=1):
    out, k = plain(data, target, runs)
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    want = [(*x[:4], r + 1 if r < k else None) for r, x in enumerate(order)] + [(*x[:4], None) for x in out if not x[4]]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.op12_importance_resampling(spark, sf_dir).collect()
    check(got, con.execute("SELECT doc_id, text FROM documents").fetchall(), [t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()])
    want = con.execute(queries.SQL["op12_importance_resampling"])
    names = [x[0] for x in want.description]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("runs", [1, 3])
def test_hostile(spark, monkeypatch, runs):
    """Blocks of few features and texts in many pieces, ids that are repeated and ids that are null, among them drawn ones."""
    monkeypatch.setattr(importance, "BLOCK_FEATURES", 100)
    monkeypatch.setattr(importance, "PIECE", 50)
    more = [(7000 + k % 40, f"{'word ' * 20}n{k % 13} É{k % 5}", None, None, None, None, None, None) for k in range(300)]
    more += [(None, "also " * 25, None, None, None, None, None, None)] * 30
    more += [(9000, "same text of a row " * 9, None, None, None, None, None, None)] * 100
    data, target = rows() + more, ["word n1 é1 also", None, ""]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(spark.createDataFrame(data, SCHEMA), aim, runs=runs).collect()
    check(got, [(r[0], r[1]) for r in data], target, runs)


def test_empty_tables(spark):
    aim = spark.createDataFrame([], "text string")
    assert importance.resample(empty(spark), aim).count() == 0
    check(importance.resample(hostile(spark), aim).collect(), [(r[0], r[1]) for r in rows()], [])


def test_drawn_rows(spark):
    data = [(k, "some words of a text " * 6 + f"n{k}", None, None, k, "h", k, k) for k in range(50)]
    docs, aim = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("text n3",)], "text string")
    kept = importance.drawn_rows(docs, aim)
    drawn = {r["doc_id"] for r in importance.resample(docs, aim).collect() if r["rank"]}
    assert kept.columns == SCHEMA.names and len(drawn) == 5 and {r["doc_id"] for r in kept.collect()} == drawn
