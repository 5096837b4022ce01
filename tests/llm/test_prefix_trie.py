"""The prefix trie against a plain dictionary of prefixes."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from grainmill.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n long, rep long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(data, rebuild=True):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + t[h:]
    return out


def plain(convs):
    nodes, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].add(c)
        ends[tuple(t)].append(c)
    children = collections.defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[x] for x in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in nodes.items()}


def check(got, convs):
    rows = [tuple(r[c] for c in COLUMNS) for r in got]
    assert len(rows) == len(set(rows)) and set(rows) == plain(convs)


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got = queries.op13_prefix_trie(spark, sf_dir).collect()
    check(got, turns(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()))
    want = con.execute(queries.SQL["op13_prefix_trie"])
    names = [x[0] for x in want.description]
    assert {tuple(r[c] for c in names) for r in got} == set(want.fetchall())


def hostile():
    """Nulls, empty and long texts, repeated and tied turns, equal conversations, prefixes of others, chains that hang on chains, bases that are absent or short."""
    data = []
    for c in range(40):
        for t in range(c % 7):
            data.append((c, t, ("user", "assistant", None)[t % 3], f"turn {t} of {c % 3 if t > 1 else 0}"))
    data += [(100 + k, t, "user", f"step {t}" if t < k else f"leaf {k}") for k in range(12) for t in range(k + 1)]  # each hangs on the one before
    data += [(300, t, "user", "same words here") for t in range(400)] + [(301, t, "user", "same words here") for t in range(390)]
    data += [(k, 0, "user", "a common first turn") for k in range(1000, 1200)] + [(k, 1, "bot", f"answer {k % 50}") for k in range(1000, 1200)]
    data += [(None, 1, "user", "no conversation"), (220, None, "x", "null turn first"), (220, 0, None, None), (220, 0, "", "tied"), (220, 0, "", "tied"), (221, None, None, "")]
    data += [(-5, 0, "user", "negative"), (-25, 1, "user", "of a base that is absent"), (501, 0, "user", "one turn only"), (480, 0, "user", "long " * 50000), (481, 3, "user", "long " * 50000)]
    return [(*r, "x", -1, 7) for r in data]


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("bits", [64, 2])
def test_hostile(spark, monkeypatch, rebuild, bits):
    """Also with hashes of two bits, so that most groups hold different turns and are split."""
    monkeypatch.setattr(prefix_trie, "TURN_BITS", bits)
    data = hostile()
    rows = (prefix_trie.rebuilt if rebuild else prefix_trie.numbered)(spark.createDataFrame(data, SCHEMA))
    check(prefix_trie.trie(rows).collect(), turns(data, rebuild))


def test_empty(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_prefix_sums_over_batches():
    """Batches cut anywhere give the same fingerprints; equal prefixes have equal ones, whatever stands before."""
    rng = np.random.default_rng(0)
    sizes = [0, 5, 300, 1, 0, 17]
    depth = np.concatenate([np.arange(n + 1) for n in sizes])
    turn = np.where(depth == 0, 0, rng.integers(0, 1 << 63, len(depth))).astype(np.uint64)
    whole, before = prefix_trie.prefix_sums(depth, turn, np.uint64(0))
    want, held = [], 0
    for d, t in zip(depth.tolist(), turn.tolist(), strict=True):
        held = 0 if d == 0 else (held + t * pow(prefix_trie.FACTOR, d, 1 << 64)) % (1 << 64)
        want.append(held)
    assert whole.tolist() == want and [b for b, d in zip(before.tolist(), depth.tolist(), strict=True) if d] == [want[k - 1] for k, d in enumerate(depth) if d]
    held, parts = np.uint64(0), []
    for k in range(0, len(depth), 7):
        now, _ = prefix_trie.prefix_sums(depth[k : k + 7], turn[k : k + 7], held)
        held = now[-1]
        parts += now.tolist()
    assert parts == want
