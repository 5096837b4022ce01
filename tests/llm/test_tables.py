"""Operators on whole tables against plain versions of their contracts."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from grainmill.llm import exact_dedup, line_templates, mixing, packing, queries, sharding

from .helpers import SCHEMA, empty, hostile, rows


def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- exact dedup


def check_dedup(got, data):
    groups = collections.defaultdict(list)
    for i, t in data:
        groups[lower(t)].append(i)
    assert len(got) == len(data)
    by = collections.defaultdict(list)
    for i, t in data:
        by[i].append(hashlib.sha256(lower(t).encode()).hexdigest())
    of = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
    for r in got:
        own = of[r["text_sha256"]]
        keep = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep) and r["text_sha256"] in by[r["doc_id"]]


def test_dedup_query(spark, sf_dir):
    check_dedup(queries.op9_bloom_dedup(spark, sf_dir).collect(), [(i, t) for i, t, _ in docs(spark, sf_dir)])


def test_dedup_hostile(spark):
    check_dedup(exact_dedup.exact_dedup(hostile(spark)).collect(), [(r[0], r[1]) for r in rows()])
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1 << 15, 1 << 26])
def test_dedup_keeps_one_of_each_text(spark, monkeypatch, bits):
    """Also with a filter so small that it passes most rows."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    data = [(k, f"text {k % 700} {'A' if k % 3 else 'a'}", None, None, k, None, None, None) for k in range(2000)]
    kept = exact_dedup.keep_rows(spark.createDataFrame(data, SCHEMA))
    assert kept.columns == SCHEMA.names
    got = sorted(r["doc_id"] for r in kept.collect())
    want = {}
    for r in data:
        want[lower(r[1])] = r[0]
    assert got == sorted(want.values())


NAMES = ["doc_id", "text", "_row", "_may", "_id", "h", "may", "_sha", "_page", "_bits", "doc", "gone", "name", "key", "rows", "_h", "times", "part"]


def clashing(spark, data):
    """(doc_id, text) rows with further columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, *[f"{c}{k}" for c in NAMES[2:]]) for k, (i, t) in enumerate(data)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in NAMES[2:]))


def test_dedup_stage_by_text_and_id(spark):
    """One row of each text: the largest doc_id, one of the rows that have it, with its own other columns."""
    data = [(5, "a"), (7, "A"), (5, "b"), (3, "b"), (1, "x"), (1, "x"), (None, "n"), (None, "n"), (None, "m"), (4, "m"), (9, None), (8, ""), *[(20, "hot")] * 40, (2, "alone")]
    kept = exact_dedup.keep_rows(clashing(spark, data))
    assert kept.columns == NAMES
    got = collections.Counter((r["doc_id"], lower(r["text"])) for r in kept.collect())
    assert got == collections.Counter([(7, "a"), (5, "b"), (1, "x"), (None, "n"), (4, "m"), (9, ""), (20, "hot"), (2, "alone")])
    own = {(f"_row{k}", f"h{k}"): (i, t) for k, (i, t) in enumerate(data)}
    assert all(own[r["_row"], r["h"]] == (r["doc_id"], r["text"]) for r in kept.collect())


def test_rows_without_some_keep_their_columns(spark):
    df = clashing(spark, [(k if k % 5 else None, str(k)) for k in range(50)])
    left = exact_dedup.without(df, spark.createDataFrame([(3,), (4,), (None,)], "_id long"))
    assert left.columns == NAMES and sorted(r["doc_id"] for r in left.collect()) == [k for k in range(50) if k % 5 and k not in (3, 4)]


def test_words_of_the_first_filter_show_every_repeat(spark):
    """Whatever the width, a value that comes twice is in a word that passes; at full width few others are."""
    import random

    rng = random.Random(3)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    data = values + values[:100] + values[:7] * 20
    df = spark.createDataFrame([(v,) for v in data], "h long")
    for rows in (1, 40, len(data)):
        passed = collections.Counter(r["_row"]["h"] for r in exact_dedup.tested(df, F.col("h"), df, rows).filter("_may").collect())
        assert set(values[:100]) <= set(passed)
    assert len(passed) < 400


def test_dedup_filter_lets_unique_rows_through(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.xxhash64(exact_dedup.normal(F.col("text"))).alias("h"))
    n = d.count()
    may = exact_dedup.tested(d, F.col("h"), d, n).filter("_may").count()
    repeated = d.groupBy("h").count().filter("count > 1").agg(F.sum("count")).first()[0] or 0
    assert repeated <= may <= repeated + n // 10


# ---- sharding


def plain_ring(data, shards):
    """Rows one by one: each row in turn takes the first shard with room, from its cell clockwise; rows that stay come first."""
    nodes = sharding.ring(shards)
    counts = collections.Counter(c for c in data)
    room = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]
    place = {}
    for last in (False, True):
        for cell in sorted(counts):
            k = next((m for m, (at, _) in enumerate(nodes) if at >= cell), 0)
            for rank in range(counts[cell]):
                if (cell, rank) in place:
                    continue
                step = k
                while last and not room[nodes[step][1]]:
                    step = (step + 1) % len(nodes)
                if room[nodes[step][1]]:
                    room[nodes[step][1]] -= 1
                    place[cell, rank] = nodes[step][1]
    return place


@pytest.mark.parametrize("n", [0, 1, 39, 40, 41, 500])
def test_ring_against_rows_one_by_one(n):
    import random

    rng = random.Random(n)
    cells = [rng.choice([rng.randrange(sharding.CELLS), 77]) for _ in range(n)]
    got = {}
    for cell, a, b, s, slot in sharding.assign(collections.Counter(cells), 40):
        for r in range(a, b):
            got[cell, r] = s
    assert got == plain_ring(cells, 40)
    loads = collections.Counter(got.values())
    assert max(loads.values(), default=0) - min((loads.get(s, 0) for s in range(40)), default=0) <= 1


def check_shards(got, data):
    assert len(got) == len(data)
    slots = collections.defaultdict(list)
    sizes = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data)
    assert sizes == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert sum(counts) == len(data) and max(counts) - min(counts) <= 1


def test_shard_query(spark, sf_dir):
    data = [(i, t) for i, t, _ in docs(spark, sf_dir)]
    got = queries.op8_ring_sharding(spark, sf_dir).collect()
    check_shards(got, data)
    again = {r["doc_id"]: r["shard"] for r in queries.op8_ring_sharding(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in got}


def test_shards_hostile(spark):
    check_shards(sharding.ring_shards(hostile(spark)).collect(), [(r[0], r[1]) for r in rows()])
    assert sharding.ring_shards(empty(spark)).count() == 0


def test_shards_of_one_hot_row(spark):
    """One doc_id, or none, holds most rows, with one text and with many."""
    data = [(None, "same")] * 3000 + [(7, f"t{k}") for k in range(1500)] + [(k, "x") for k in range(500)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = sharding.ring_shards(df).collect()
    check_shards(got, data)
    order = lambda rows: sorted((r["doc_id"] or -1, r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert order(got) == order(sharding.ring_shards(df.repartition(3)).collect())


def test_one_more_shard_moves_little():
    import random

    cells = collections.Counter(random.Random(2).randrange(sharding.CELLS) for _ in range(20000))
    at = lambda n: {(c, r): s for c, a, b, s, _ in sharding.assign(cells, n) for r in range(a, b)}
    a, b = at(40), at(41)
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


# ---- mixing


def check_mix(got, data):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, s in data:
        total[s] += size(t)
    goal = mixing.targets(list(total.items()))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(total.values()))
    want = collections.Counter((i, size(t), total[s], s) for i, t, s in data)
    assert want == collections.Counter((r["doc_id"], r["size"], r["source_size"], r["source"]) for r in got)
    taken, most = collections.Counter(), collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    for s in total:
        assert goal[s] <= 2 * total[s] + 1e-6 and abs(taken[s] - goal[s]) <= most[s]


def test_mix(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = docs(spark, sf_dir)
    one, two = (sorted(mixing.mix(df).collect(), key=lambda r: r["doc_id"]) for _ in range(2))
    check_mix(one, data)
    assert one == two


def test_mix_against_running_sums(spark, sf_dir):
    """The thresholds from histograms take what a sort by hash takes."""
    data = docs(spark, sf_dir)
    got = {r["doc_id"]: r for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    by = collections.defaultdict(list)
    for i, t, s in data:
        by[s].append((int(hashlib.md5(f"{i}|{t or ''}".encode()).hexdigest()[:15], 16), i))
    for own in by.values():
        first = got[own[0][1]]
        whole = int(first["target"] // first["source_size"])
        need, run = first["target"] - whole * first["source_size"], 0
        for _, i in sorted(own):
            n = got[i]["size"]
            assert got[i]["taken"] == n * (whole + (2 * run + n < 2 * need)) or n == 0
            run += n


def test_mix_hostile(spark):
    got = mixing.mix(hostile(spark)).collect()
    assert len(got) == len(rows()) and mixing.mix(empty(spark)).count() == 0
    once = [r for r in rows() if r[0] != 4]
    check_mix(mixing.mix(spark.createDataFrame(once, SCHEMA)).collect(), [(r[0], r[1], r[3]) for r in once])
    assert mixing.mixed_rows(hostile(spark)).columns == SCHEMA.names


def test_mix_of_many_sources_and_of_rows_without_ids(spark):
    """Sources beyond one range of the sort, null ids that are told apart by text, clashing columns."""
    data = [(None if k % 3 else k, f"{'w ' * (k % 17)}{k}", f"s{k % 211}" if k % 10 else None, *["x"] * 5) for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, key string, rows string, h string, size string, past string")
    check_mix(mixing.mix(df).collect(), [r[:3] for r in data])
    assert mixing.mixed_rows(df).columns == df.columns


# ---- packing


def check_pieces(got, data, length=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == {i for i, _ in data}
    for i, text in data:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(raw)
            at += r["length"]
        assert at == len(ids)
    used = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
        used += at
    return 1 - used / (length * len(sequences))


def test_packing_query(spark, sf_dir):
    waste = check_pieces(queries.op5_cost_packing(spark, sf_dir).collect(), [(i, t) for i, t, _ in docs(spark, sf_dir)])
    assert waste < 0.02


ODD = ["", None, "don't we'll I've they're it's 'x 'S", "  two  spaces \n\n\t tabs\r\n end  ", "a b c　 d", "naïve Straße 123abc٣٤ ½ ǅ ​ x", "🙂🙂 !!!???...", " " * 50, "\n" * 7 + "x", "<|endoftext|", "x" * 3000, "\x00\x01 \x85\x1c"]


def test_packing_odd_texts(spark):
    data = [(k, t) for k, t in enumerate(ODD)]
    check_pieces(packing.pack(spark.createDataFrame(data, "doc_id long, text string"), queries.tokenizer_path()).collect(), data)
    got = packing.pack(hostile(spark), queries.tokenizer_path())
    assert got.select(F.sum("length")).first()[0] >= len(rows()) and packing.pack(empty(spark), queries.tokenizer_path()).count() == 0


def test_packing_spreads_the_copies_of_one_row(spark):
    data = [(None, "the same text again")] * 4000 + [(k, "x y") for k in range(100)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string").repartition(2), queries.tokenizer_path(), bin_docs=100).collect()
    assert len({r["doc_id"] for r in got}) == 101 and sum(r["start"] == 0 for r in got) == len(data)
    bins = collections.Counter(r["sequence_id"] >> 32 for r in got if r["doc_id"] is None)
    assert len(bins) > 20 and max(bins.values()) < 1000


@pytest.mark.parametrize("seed", range(6))
def test_place_fills_all_but_one(seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(0, 100), rng.randrange(60, 100)]) for _ in range(rng.choice([1, 2, 40, 300]))]
    parts, used = packing.place(lengths, 100), collections.defaultdict(list)
    for n, own in zip(lengths, parts, strict=True):
        assert sorted(p[0] for p in own) == [sum(q[1] for q in sorted(own)[:k]) for k in range(len(own))] and sum(p[1] for p in own) == n
        for _, size, s, offset in own:
            used[s].append((offset, size))
    loads = []
    for own in used.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        loads.append(at)
    assert all(x <= 100 for x in loads) and sum(x < 100 for x in loads) <= 1


# ---- line templates


def plain_lines(data):
    """The tree with dictionaries, by words themselves: what each word's support is, what a line's template keeps, where it recurs."""
    lines, seen = [], collections.defaultdict(set)
    for row, (i, text) in enumerate(data):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            w = tuple(("<*>" if re.search("[0-9]", x) else x) for x in re.split(r"[\x20\x09-\x0D]+", lower(line)) if x)
            if len(w) >= 3:
                lines.append((row, (i, text), k, w))
                seen[len(w), w[:2]].add((i, text))
    support = collections.Counter((len(w), w[:2], p, x) for _, _, _, w in lines for p, x in enumerate(w) if x != "<*>")
    where = collections.defaultdict(set)
    mine = {}
    for row, doc, k, w in lines:
        n = len(w)
        if len(seen[n, w[:2]]) < (2 if n >= 50 else 4):
            continue
        # What tells a template are words that other lines of the leaf have too, beyond the two that put them there.
        shared = {p: support[n, w[:2], p, x] for p, x in enumerate(w) if p > 1 and x != "<*>" and support[n, w[:2], p, x] > 1}
        names = [("line", n, w)]
        least = max(2, (n - 2 + 1) // 2)
        if len(shared) >= least:
            reach = sorted(shared.values())[-least]
            names.append(("template", n, w[:2], tuple((p, w[p]) for p, h in shared.items() if 2 * h >= reach)))
        mine[row, k] = names
        for name in names:
            where[name].add(doc)
    gone = {at for at, names in mine.items() if any(len(where[x]) >= (2 if x[0] == "line" and x[1] >= 50 else 4) for x in names)}
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (row, k) not in gone)) for row, (i, t) in enumerate(data)}


def test_lines_query(spark, sf_dir):
    data = [(i, t) for i, t, _ in docs(spark, sf_dir)]
    got = queries.op4_template_line_dedup(spark, sf_dir).collect()
    want = plain_lines(data)
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert sum(r["n_dropped"] for r in got) > 0


def test_templates_generalise(spark):
    data = [(k, f"Session {k} opened for user {name} at port {k * 7}\nA line of its own number{'abcdefgh'[k]} {name} here {name}{name}") for k, name in enumerate(["ann", "bob", "cy", "dee", "eve", "flo"])]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_lines(data)


def dropped(spark, data):
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_lines(data)
    return {i for i, t in got.items() if not t}


def test_a_leaf_holds_several_templates(spark):
    """Three templates of eight words with the same two leading words; strays do not make their words variable."""
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    forms = ["the system has been started by user {}", "the system could not reach its {} today", "the system {} keeps old files for now"]
    data = [(k, f.format(word())) for k, f in enumerate(f for f in forms for _ in range(8))]
    assert dropped(spark, data) == set(range(24))
    strays = [(100 + k, f"the system {' '.join(word() for _ in range(6))}") for k in range(40)]
    assert dropped(spark, data + strays) == set(range(24))


@pytest.mark.parametrize("narrow", [(1, 1), (3, 30), (64, 1 << 16)])
def test_templates_of_one_and_many_blocks_agree(spark, monkeypatch, narrow):
    """Whether a leaf's lines are compared in one row or counts of many are summed, or some of each."""
    import random

    monkeypatch.setattr(line_templates, "BLOCK", narrow[0])
    monkeypatch.setattr(line_templates, "BLOCK_WORDS", narrow[1])
    rng = random.Random(6)
    pick = lambda k: rng.choice(["ab", "cd", "ef", "gh", "x1", "yz", "qq"][:k])
    data = [(k, "\n".join(" ".join(["go", pick(2), *(pick(rng.choice([1, 2, 7])) for _ in range(rng.choice([3, 4, 8, 60])))]) for _ in range(rng.randrange(4)))) for k in range(150)]
    gone = dropped(spark, data)
    assert gone and len(gone) < len(data)


def test_lines_that_share_an_opening_stay(spark):
    """Distinct short lines with one usual opening, many of them, beside templates of the same leaves that go."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    prose = ["I think so", "I think not", "i think maybe", "I THINK tomorrow"] + [f"I think {word()}" for _ in range(30)]
    prose += [f"you know nothing {word()} {word()}" for _ in range(30)] + [f"we saw the {word()}" for _ in range(30)] + [f"it was {word()} {word()} {word()} {word()}" for _ in range(30)]
    data = list(enumerate(prose)) + [(1000 + k, f"you know that {word()} sleeps") for k in range(6)] + [(2000 + k, f"it was read by {word()} again") for k in range(6)]
    assert dropped(spark, data) == {i for i, _ in data if i >= 1000}
    assert dropped(spark, list(enumerate(["I think so", "I think not", "i think maybe", "I THINK tomorrow"]))) == set()


def test_long_lines_recur_from_two_documents_on(spark):
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    data = [(1, long + "\nown words of one"), (2, "own words of two\n" + long), (3, "few words shared"), (4, "few words shared"), (5, "few words shared")]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == plain_lines(data) == {1: "own words of one", 2: "own words of two", **dict(data[2:])}


def test_lines_with_clashing_columns(spark):
    df = clashing(spark, [(k, f"a line of words for {'abcdefgh'[k % 8]}\nshared by all of them") for k in range(8)]).withColumn("n_lines", F.lit("mine"))
    got = line_templates.drop_recurring(df)
    assert got.columns == [*NAMES, "n_lines", "n_dropped"]
    assert {(r["text"], r["n_lines"], r["n_dropped"], r["doc"]) for r in got.collect()} == {("", 2, 2, f"doc{k}") for k in range(8)}


def test_lines_hostile(spark):
    got = line_templates.drop_recurring(hostile(spark))
    assert got.count() == len(rows()) and got.columns == [*SCHEMA.names, "n_lines", "n_dropped"]
    assert line_templates.drop_recurring(empty(spark)).count() == 0
