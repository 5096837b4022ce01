"""Each stage of the pipeline on what the stage before kept, against a plain version."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from grainmill.llm import language_id, mixing  # noqa: E402
from grainmill.llm.common import read, written  # noqa: E402

from .helpers import SCHEMA, empty, hostile  # noqa: E402
from .test_jaccard import plain_components  # noqa: E402
from .test_tables import check_mix, lower  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents, then the rows after each stage."""
    docs = read(spark, sf_dir, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_what_it_accepts(spark, stages):
    before, after = texts(stages[0]), dict(texts(stages[1]))
    from pyspark.sql import functions as F

    found = language_id.identify(stages[0], language_id.fit(language_id.sample(stages[0], "doc_id", "text", "lang")), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    ok = {r["id"] for r in found.collect() if r["accepted"]}
    assert set(after) == ok and len(after) >= 0.98 * len(before)


def test_language_rejects_what_has_no_letters(spark):
    data = [(k, "The quick fox and the lazy dog walk home " * 3, "en", "s", 1) for k in range(20)] + [(98, "12345 !!! 678", "en", "s", 1), (99, "", "en", "s", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()} == set(range(20))


def test_exact_keeps_the_largest_id(stages):
    want = {}
    for i, t in texts(stages[1]):
        want[lower(t)] = max(i, want.get(lower(t), i))
    assert sorted(i for i, _ in texts(stages[2])) == sorted(want.values())


def test_near_keeps_the_smallest_id(stages):
    docs = texts(stages[2])
    comps = plain_components(docs)
    assert sorted(i for i, _ in texts(stages[3])) == sorted(i for i, (_, c) in comps.items() if c == i)


def test_mixing_takes_and_repeats(stages):
    got = mixing.mix(stages[3]).collect()
    check_mix(got, [(r["doc_id"], r["text"], r["source"]) for r in stages[3].collect()])
    assert collections.Counter(i for i, _ in texts(stages[4])) == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_packing_holds_every_row_once(stages):
    rows = texts(stages[4])
    got = stages[5].collect()
    times = collections.Counter(i for i, _ in rows)
    once, again = [], collections.Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        again[r["doc_id"]] += r["length"]
        once.append(r)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(tokens) == set(times) and all(again[i] == times[i] * tokens[i] for i in times)
    assert check_sequences(once) < 0.03


def test_run_is_its_stages_and_leaves_few_tables(spark, sf_dir, stages):
    from grainmill.llm import common

    before = common.mark()
    got = corpus_pipeline.run(spark, sf_dir)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, stages[5].collect()))
    assert common.mark() - before <= 2 * len(corpus_pipeline.STAGES)


def check_sequences(got, length=2048):
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    used = 0
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
        used += at
    return 1 - used / (length * len(by))


def test_stages_bear_hostile_and_empty_tables(spark):
    from pyspark.sql import functions as F

    for make in (hostile, empty):
        docs = make(spark)
        for k, c in enumerate(["_row", "key", "rows", "_may", "_id", "_h", "doc", "node", "raw", "past"]):
            docs = docs.withColumn(c, F.lit(k))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, ""))
            if name != "packing":
                assert docs.columns == columns
                assert {tuple(r) for r in docs.select(columns[-10:]).distinct().collect()} <= {tuple(range(10))}
    assert docs.count() == 0 and docs.agg(F.sum("length")).first()[0] is None
