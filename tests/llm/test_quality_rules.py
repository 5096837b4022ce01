"""The quality rules against a plain count of each text."""

import collections
import re

import duckdb
import pytest

from grainmill.llm import quality_rules, queries

from .helpers import SCHEMA, empty, hostile, rows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(3)}
    stops = sum(w in quality_rules.STOP_WORDS for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    out = (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered))
    n, failed = len(words), len(words) < 50 or 100 * len(covered) > 50 * len(words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    clean = n and 2.5 <= out[1] / n <= 12 and symbols / n <= 0.1 and stops / n >= 0.05 and out[3] / len(lines) <= 0.3 and out[4] / n <= 0.3 and letters / n >= 0.7
    return (*out, failed, bool(not failed and clean))


def check(got, data):
    key = lambda x: tuple((v is None, v or 0) for v in x)
    mine = sorted(((r["doc_id"], *(r[c] for c in COUNTS), r["base_failed"], r["kept"]) for r in got), key=key)
    assert mine == sorted(((i, *plain(t)) for i, t in data), key=key)


def test_query(spark, sf_dir):
    data = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = queries.op11_quality_rules(spark, sf_dir).collect()
    check(got, data)
    assert len({r["kept"] for r in got}) == 2


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.op11_quality_rules(spark, sf_dir)
    want = con.execute(queries.SQL["op11_quality_rules"])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())


def more():
    """Texts that repeat in part, wholly, at their ends and by overlap, with words that hold symbols and letters of other scripts."""
    texts = ["a b c a b c", "a a a a", "a b c d a b", "x y z\nx y z\n\n x y z", "ß ü ß ü ß ü", "… - • ...", "the of and " * 30, "1 2 3 " * 40 + "end", "a" * 100000, "q\x1fw e\x85r t y", " ".join(map(str, range(5000)))]
    return [(100 + k, t, None, None, None, None, None, None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("place", [1 << 31, 1 << 61])
def test_hostile(spark, monkeypatch, place):
    """Also with hashes of three bits, which all meet."""
    monkeypatch.setattr(quality_rules, "PLACE", place)
    data = rows() + more()
    check(quality_rules.quality(spark.createDataFrame(data, SCHEMA)).collect(), [(r[0], r[1]) for r in data])
    assert quality_rules.quality(empty(spark)).count() == 0


def test_rules_of_ones_own(spark):
    rule = quality_rules.Rule("few_lines", "n_lines", None, None, 1)
    df = spark.createDataFrame([(1, "the word of a man and " * 20), (2, "\n".join(f"{k} {k}x" for k in range(30)))], "k long, t string")
    got = {r["doc_id"]: (r["broken_rules"], r["base_failed"], r["kept"]) for r in quality_rules.quality(df, "k", "t", (rule,)).collect()}
    assert got == {1: ("", True, False), 2: ("few_lines", False, False)}


def test_keep_rows_carries_columns(spark):
    df = hostile(spark).unionByName(spark.createDataFrame([(50, " ".join(f"the {k} word" for k in range(60)), "en", "s", 1, "h", 2, 3)], SCHEMA))
    kept = quality_rules.keep_rows(df, rules=())
    assert kept.columns == SCHEMA.names
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t, *_ in [*rows(), (50, " ".join(f"the {k} word" for k in range(60)))] if not plain(t)[5]}
