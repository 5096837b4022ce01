"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from grainmill.llm import jaccard, queries

from .helpers import SCHEMA, empty, hostile, rows


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def plain_components(docs):
    sets = {i: plain_set(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    share = {}
    for own in where.values():
        for m, a in enumerate(own):
            for b in own[m + 1 :]:
                share[a, b] = share.get((a, b), 0) + 1
    for (a, b), n in share.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, docs):
    want = plain_components(docs)
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op1_partenum_jaccard(spark, sf_dir).collect(), docs)


def corpus(seed, sizes, near):
    """Random texts with chains of edits on both sides of the threshold, and passages that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    texts = []
    for n in sizes:
        base = [word() for _ in range(n)]
        if rng.random() < 0.4:
            base[n // 2 : n // 2] = passage
        texts.append(base)
        for _ in range(near):
            base = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 24))):
                base[rng.randrange(len(base))] = word()
            if rng.random() < 0.3:
                base += [word() for _ in range(len(base) // 8)]
            texts.append(base)
    rng.shuffle(texts)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_near_the_threshold(spark, seed):
    rng = random.Random(seed)
    docs = corpus(seed, [rng.choice((6, 12, 30, 45, 80, 150, 400)) for _ in range(60)], 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    check(jaccard.components(df).collect(), docs)


def test_large_groups_in_small_buffers(spark, monkeypatch):
    """A buffer of a few rows makes runs split into parts; components stay whole."""
    docs = corpus(3, [40] * 4, 40)
    bucket = jaccard._Bucket(0)
    bucket.limit = 5
    monkeypatch.setattr(jaccard, "BUFFER", 5)
    for k in range(30):
        bucket.add(np.array([9, k], np.uint32), np.array([k, k], np.int64))
    bucket.cut(True)
    seen = {x for _, m in bucket.parts for x in m.tolist()}
    assert seen == set(range(30)) and max(len(m) for _, m in bucket.parts) < 30
    monkeypatch.undo()
    check(jaccard.components(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def signed(sets, marks=None):
    sigs, ids = jaccard.signatures(sets, marks)
    return [set(sigs[ids == k].tolist()) for k in range(len(sets))]


@pytest.mark.parametrize("often", [0.0, 0.3, 0.8, 1.0])
def test_signatures_are_shared_by_all_linked_sets(often):
    """Of every size, with any share of features in frequent cells."""
    rng = np.random.default_rng(5)
    bits = rng.random(jaccard.CELLS) < often
    marks = np.packbits(bits, bitorder="little").tobytes() if often else None
    for _ in range(500):
        n = int(rng.choice([*range(1, 30), 31, 32, 33, 41, 42, 43, 57, 63, 64, 65, 75, 101, 300, 1000]))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        both = int(np.ceil(0.75 * n)) if rng.random() < 0.5 else n
        b = a[:both] if rng.random() < 0.5 else np.concatenate([a, rng.integers(0, 1 << 64, n // 3, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        if jaccard.linked(a, b) and len(a) != len(b):
            x, y = signed([a, b], marks)
            assert x & y, (len(a), len(b))
            assert jaccard.may_link(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b))


def test_word_sets_in_pieces(monkeypatch):
    """Counts agree with plain sets wherever texts are cut, and equal texts have equal sets."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "B", "cc", "d\u00c9", "\x00", "x" * 40]) + rng.choice(["", "\n", "\t\t", "\x0b", " ,"]) for _ in range(rng.randrange(0, 300))) for _ in range(80)] + ["", " ", "y" * 5000, "\x00", "\x00\x00"]
    raw = [t.encode() for t in texts]
    whole = jaccard.word_sets(raw)
    assert [len(s) for s in whole] == [len(plain_set(t)) for t in texts]
    monkeypatch.setattr(jaccard, "PIECE", 64)
    for t, s in zip(raw, whole, strict=True):
        assert (jaccard.word_sets([t.upper() if t.isascii() else t])[0] == s).all()
    for a, b in zip(jaccard.word_sets(raw), whole, strict=True):
        assert (a == b).all()


def test_a_passage_of_very_many_texts_makes_no_crowd():
    """Texts with one common passage and else unrelated: features of the passage sign nothing, so runs stay short however many texts share it."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(15))
    texts = [f"{' '.join(f'w{rng.randrange(10**7)}' for _ in range(35))} {passage}".encode() for _ in range(10_000)]
    sets = jaccard.word_sets(texts)
    counts = np.bincount(jaccard._cell(np.concatenate(sets)), minlength=jaccard.CELLS)

    def longest(marks):
        sigs, _ = jaccard.signatures(sets, marks)
        return int(np.unique(sigs, return_counts=True)[1].max())

    assert longest(np.packbits(counts > jaccard.FREQUENT, bitorder="little").tobytes()) <= jaccard.SMALL < 2000 < longest(None)


def test_counts_of_cells_by_pages():
    rng = np.random.default_rng(2)
    for share in (0.001, 0.9):
        parts = [np.where(rng.random(jaccard.PAGE_CELLS) < share, rng.integers(0, 256, jaccard.PAGE_CELLS), 0).astype(np.uint8) for _ in range(3)]
        total = np.zeros(jaccard.PAGE_CELLS, np.int64)
        for p in parts:
            jaccard._add_page(total, jaccard._page(p))
        assert (total == sum(p.astype(np.int64) for p in parts)).all()


@pytest.mark.parametrize("part", [7, 1 << 16])
def test_components_of_links(spark, monkeypatch, part):
    """Paths, stars and random links, in parts of a few links and in one."""
    from grainmill.llm import components

    monkeypatch.setattr(components, "PART", part)
    rng = random.Random(part)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(400, 400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hostile_rows(spark):
    data = [(r[0], r[1]) for r in rows()]
    check(jaccard.components(hostile(spark)).collect(), data)
    assert jaccard.components(empty(spark)).count() == 0
    kept = jaccard.keep_rows(hostile(spark))
    assert kept.columns == SCHEMA.names and kept.count() < len(data)
