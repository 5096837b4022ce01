"""N-gram Jaccard join by PartEnum signatures.

A document's set holds 64-bit hashes of its distinct WORDS-word shingles. Two sets link when 7 x |difference| <= |A| + |B|,
which is a Jaccard similarity of 0.75. A partner of a set of n features differs from it by k = n // 3 at most.

Frequent features. One pass over all texts counts features in CELLS cells by hash. A cell with more than FREQUENT features, and more
than CROWDED times the mean, is frequent. Leaving frequent features out of all sets lowers no difference above k, so signatures
of the others are still complete, and a passage that very many documents share brings none of them together.

Signatures, at every size. Sizes fall into bands, [B, 16/9 B); a set is in its own band and, when a partner can be smaller than its band, in
the one below, so two sets that may link are in a common band. A band splits the feature domain into groups of three partitions. Sets
that agree in all but one partition of a group agree on two of the three, so each pair of a group's partitions gives one signature,
a hash of its features. At a difference of at most k, one of k // 2 + 1 groups differs by one feature at most. A set
signs its groups in order until k // 2 + 1 of them have two partitions that are not empty; empty pairs are not signed, so nothing but
shared features brings sets together. A set that runs out of groups, being short or made of frequent features, signs all of them and its
k + 1 least features besides, those of frequent cells last: two such sets that link share one of these, and of any other
two that link the one that stops first shares a signature of its full groups with the other. So no link is lost.

Buckets. Signatures travel in blobs by bucket, not as rows. A bucket is read as a stream: runs of equal signatures
that are longer than SMALL are cut down to their smallest set whenever the buffer is full and given out as parts, so a hot signature
takes no more memory than others. Runs of at most SMALL sets give their pairs, longer ones first give pairs with their smallest set.

Checks. Pairs pass by size and parity sketch (bit h mod M flipped by each feature), which differs in no more bits than the sets
do, and then by whole texts, of which a centre's travels once a block of its partners. Each set is first checked against its smallest
candidate. Then come the other pairs between the components of these links and, of the long runs, gathered by the runs' smallest set
in blocks of BLOCK sets, as many pairs as may connect components; what is apart after that is checked pair by pair. A pair inside one component needs no
check, so the operator gives components and not the number of links. What stays quadratic is a crowd of documents that consist by more than two thirds of
the same frequent passages and yet do not link: sketches of all its pairs are compared, in blocks.

Equal sets are one node, named by 64 bits of their 128-bit digest; two sets of one name only make more pairs to check, and are paired with each
other. Null, empty and word-less texts have size 0 and are alone. Ties: a component's name is its smallest doc_id, so the order of rows is
of no account. Very long texts are cut into shingles in pieces and otherwise treated as others. Rows repeated with one doc_id are one vertex: links of any of its
texts join its component, and each row is named by its own text's. A null doc_id is alone with a null component. An empty table gives no rows. Other
columns, of whatever name, are ignored by components() and carried along by keep_rows().
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, join_groups, written
from .components import connected
from .exact_dedup import _power, key_filter, may_repeat, without

WORDS = 5
SMALL = 4
BLOCK = 2048
FINE, LEAST = 32, 2048  # sketch bits a difference, and at least
FILL = 1.6  # features of the band's largest set in a partition
BUFFER = 500_000
PIECE = 1 << 18  # bytes of text that are hashed at once
CELLS, PAGE_CELLS = 1 << 24, 1 << 16
FREQUENT, CROWDED = 256, 16
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOW = np.arange(1, 257, dtype=np.uint64)  # a byte's value in a word's hash, A-Z as a-z
_LOW[65:91] += np.uint64(32)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    out = []
    for base in (0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)):
        x = np.ones(n, np.uint64)
        x[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a byte array that ends in white space."""
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    up, down = _powers(max(2 * PIECE, _power(len(buf))))
    sums = np.cumsum(_LOW[buf] * up[: len(buf)], dtype=np.uint64)
    return start, mix((sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))) * down[start])


def word_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; white space and letters are ASCII's."""
    hashes, owner, k = [], [], 0
    while k < len(texts):
        m, size = k, 0
        while m < len(texts) and (m == k or size + len(texts[m]) < PIECE):
            size += len(texts[m]) + 1
            m += 1
        if m == k + 1:  # perhaps a long one: cut at white space
            text, at = texts[k], 0
            while at < len(text):
                to = at + PIECE
                while to < len(text) and text[to] not in b" \t\n\v\f\r":
                    to += 1
                h = _word_hashes(np.frombuffer(text[at:to] + b" ", np.uint8))[1]
                hashes.append(h)
                owner.append(np.full(len(h), k))
                at = to
        else:
            start, h = _word_hashes(np.frombuffer(b" ".join(texts[k:m]) + b" ", np.uint8))
            ends = np.cumsum([len(t) + 1 for t in texts[k:m]])
            hashes.append(h)
            owner.append(k + np.searchsorted(ends, start, side="right"))
        k = m
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    count = np.bincount(np.concatenate(owner), minlength=len(texts)) if hashes else np.zeros(len(texts), np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    x = w[: max(0, len(w) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        x = x * _M1 + w[k : len(w) - WORDS + 1 + k] if len(x) else x
    x = mix(x)
    out = []
    for k, n in enumerate(count.tolist()):
        a = int(at[k])
        if n >= WORDS:
            s = np.sort(x[a : a + n - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            one = np.array([n], np.uint64)
            for h in range(a, a + n):
                one = mix(one * _M3 + w[h : h + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: bytes) -> np.ndarray:
    return word_sets([text])[0]


def sketch(s: np.ndarray) -> bytes:
    """Parities of the features by hash, FINE bits or more for each difference that is allowed."""
    bits = _power(max(LEAST, FINE * (len(s) // 3)))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


# ---- frequent features


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def frequent_cells(marks: bytes | None, s: np.ndarray) -> np.ndarray:
    """Which features lie in a frequent cell; marks has a bit for each cell."""
    if marks is None:
        return np.zeros(len(s), bool)
    cell = _cell(s)
    return (np.frombuffer(marks, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & np.uint8(1) != 0


def _page(counts: np.ndarray) -> bytes:
    """A page of counts up to 255, as places and counts where most are zero."""
    held = np.flatnonzero(counts)
    raw = b"d" + counts.tobytes() if 3 * len(held) > PAGE_CELLS else b"s" + held.astype("<u2").tobytes() + counts[held].tobytes()
    return zlib.compress(raw, 1)


def _add_page(total: np.ndarray, page: bytes) -> None:
    raw = zlib.decompress(page)
    if raw[:1] == b"d":
        total += np.frombuffer(raw, np.uint8, offset=1)
    else:
        n = (len(raw) - 1) // 3
        total[np.frombuffer(raw, "<u2", n, 1)] += np.frombuffer(raw, np.uint8, n, 1 + 2 * n)


# ---- signatures


def _bounds() -> list[int]:
    out = [1, 3, 6]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 16 // 9 + 1)
    return out


BOUNDS = _bounds()


def bands(n: int) -> list[int]:
    """The bands of a set of n features."""
    own = bisect.bisect_right(BOUNDS, n) - 1
    return [own] if not own or 3 * n > 4 * (BOUNDS[own] - 1) else [own, own - 1]


def groups_of(band: int) -> int:
    most = 4 * (BOUNDS[band + 1] - 1) // 3
    return max(most // 3 // 2 + 1, int(most / (3 * FILL)))


def signatures(sets: list[np.ndarray], marks: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set) of all sorted sets together."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sets = [s if len(s) > 2 else s[:0] for s in sets]  # shorter ones link with equal sets only
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return none
    feats = np.concatenate(sets)
    often = frequent_cells(marks, feats)
    at = np.concatenate([[0], np.cumsum(size)])
    cool = feats[~often]
    cool_at = np.concatenate([[0], np.cumsum(~often)])[at]
    own, band, pieces = [], [], []
    for k, n in enumerate(size.tolist()):
        for b in bands(n) if n else ():
            own.append(k)
            band.append(b)
            pieces.append(cool[cool_at[k] : cool_at[k + 1]])
    own, band = np.array(own), np.array(band)
    per = np.array([groups_of(b) for b in range(band.max() + 1)])[band]  # groups of each (set, band)
    need = size[own] // 3 // 2 + 1
    s = np.concatenate(pieces)
    count = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(per)])  # of each (set, band), its first group in the row of all groups
    which = np.repeat(np.arange(len(own)), count)
    slot = 3 * first[which] + (((s >> np.uint64(32)) * (3 * per[which]).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    content = np.zeros(3 * first[-1], np.uint64)
    if len(s):
        begin = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted, so slots ascend
        content[slot[begin]] = np.add.reduceat(mix(s + (band[which] + 1).astype(np.uint64)), begin) | np.uint64(1)
    content = content.reshape(-1, 3)
    full = (content != 0).sum(1) >= 2
    pair = np.repeat(np.arange(len(own)), per)
    before = np.concatenate([[0], np.cumsum(full)])
    done = before[:-1] - before[first[:-1]][pair]  # full groups of the (set, band) before this one
    signs = done < need[pair]
    short = before[first[1:]] - before[first[:-1]] < need
    base = ((np.arange(len(content)) - first[:-1][pair]) * 4 + (band[pair] << 40)).astype(np.uint64)
    sigs, ids = [], []
    for k, (x, y) in enumerate(((0, 1), (0, 2), (1, 2))):
        held = np.flatnonzero(signs & ((content[:, x] | content[:, y]) != 0))
        sigs.append(mix(mix(content[held, x] + base[held] + np.uint64(k)) + content[held, y]))
        ids.append(own[pair[held]])
    for k in np.unique(own[short]).tolist():
        a, b = at[k], at[k + 1]
        order = np.argsort(often[a:b], kind="stable")[: size[k] // 3 + 1]
        sigs.append(mix(feats[a:b][order] ^ _M3))
        ids.append(np.full(len(order), k))
    return np.concatenate(sigs), np.concatenate(ids)


# ---- passes over the texts

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("fine", pa.binary()), ("page", pa.int32()), ("counts", pa.binary())])
_SETS_DDL = "doc_id long, n long, key binary, node long, fine binary, page int, counts binary"


def _key(s: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(s.tobytes())


def _node(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, and at the end pages of counts by cell."""
    counts = np.zeros(CELLS, np.uint8)
    for batch in batches:
        ids = batch.column(0)
        sets = word_sets([t or b"" for t in batch.column(1).to_pylist()])
        keys = [_key(s) for s in sets]
        feats = np.concatenate([s for s, i in zip(sets, ids.is_valid().to_pylist(), strict=True) if i] or [np.zeros(0, np.uint64)])
        cell, times = np.unique(_cell(feats), return_counts=True)
        counts[cell] = np.minimum(counts[cell] + times, 255)
        columns = [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(map(_node, keys), pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=_SETS)
    pages = counts.reshape(-1, PAGE_CELLS)
    some = np.flatnonzero(pages.any(1)).tolist()
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), f.type) for f in list(_SETS)[:5]), pa.array(some, pa.int32()), pa.array([_page(pages[k]) for k in some], pa.binary())], schema=_SETS)


_MARKS = pa.schema([("page", pa.int32()), ("bits", pa.binary())])


def _marks(least: int):
    """The bits of the cells with more than `least` features, from pages in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            bits = np.packbits(total > least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], schema=_MARKS)

        now, total = None, np.zeros(PAGE_CELLS, np.int64)
        for batch in batches:
            for page, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if page != now:
                    if now is not None and (total > least).any():
                        yield done()
                    now = page
                    total[:] = 0
                _add_page(total, raw.as_py())
        if now is not None and (total > least).any():
            yield done()

    return run


_BLOBS = pa.schema([("bucket", pa.int64()), ("flush", pa.int64()), ("ids", pa.binary()), ("sigs", pa.binary())])
FLUSH_BITS = 20  # of an id, the place in its flush


def _planes(x: np.ndarray) -> bytes:
    """Bytes of one rank together, which packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _sign(bits: int, marks: bytes | None):
    """Blobs by bucket. A set's id is its place in a flush, so that it takes two bytes a signature, and the flush's number, given once a blob; one more row a flush,
    of a negative bucket, has the nodes by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sigs, ids, held = [], [], 0
        nodes: dict[int, int] = {}  # of a flush; an equal set that was signed stands for the others
        number = TaskContext.get().partitionId() << 20

        def flush() -> Iterator[pa.RecordBatch]:
            sig, own = np.concatenate(sigs), np.concatenate(ids)
            bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((sig, bucket))
            sig, own, bucket = ((sig[order] >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), own[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            names = np.fromiter(nodes, np.int64, len(nodes))
            for k in range(0, len(at), 4096):
                ends = np.append(at, len(sig))[k : k + 4097]
                cuts = list(zip(ends[:-1], ends[1:], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]]), pa.array([number] * len(cuts), pa.int64()), pa.array([_planes(own[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(sig[a:b]) for a, b in cuts], pa.binary())], schema=_BLOBS)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - number], pa.int64()), pa.array([number], pa.int64()), pa.array([_planes(names)], pa.binary()), pa.array([b""], pa.binary())], schema=_BLOBS)

        for batch in batches:
            fresh: list[np.ndarray] = []
            first = len(nodes)
            for s in word_sets([t or b"" for t in batch.column(0).to_pylist()]):
                if len(s) > 2 and (node := _node(_key(s))) not in nodes:
                    nodes[node] = len(nodes)
                    fresh.append(s)
            sig, own = signatures(fresh, marks)
            sigs.append(sig)
            ids.append((own + first).astype(np.uint32))
            held += len(sig)
            if held >= BUFFER:
                yield from flush()
                sigs, ids, held = [], [], 0
                nodes.clear()
                number += 1
        if held:
            yield from flush()

    return run


_RUNS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("run", pa.int64()), ("members", pa.list_(pa.int64()))])
_RUNS_DDL = "a long, b long, run long, members array<long>"


class _Bucket:
    """Pairs and parts of a bucket's runs, with a buffer that is cut down when full."""

    def __init__(self, bucket: int):
        self.bucket, self.sigs, self.ids, self.held, self.limit = bucket, [], [], 0, BUFFER
        self.pairs: list[np.ndarray] = []
        self.parts: list[tuple[int, np.ndarray]] = []
        self.long: set[int] = set()  # signatures of runs that parts were given out of
        self.split = False  # whether a run may have several parts, which must then keep its name

    def add(self, sigs: np.ndarray, ids: np.ndarray) -> None:
        self.sigs.append(sigs)
        self.ids.append(ids)
        self.held += len(sigs)
        if self.held > self.limit:
            self.cut(False)

    def cut(self, last: bool) -> None:
        sig, own = np.concatenate(self.sigs), np.concatenate(self.ids)
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[fresh], own[fresh]
        at = np.flatnonzero(np.diff(sig.astype(np.int64), prepend=-1))
        size = np.diff(np.append(at, len(sig)))
        drop = np.zeros(len(sig), bool)
        for k in np.flatnonzero(size > SMALL) if not self.long else np.flatnonzero(size > 1):
            a, b = at[k], at[k] + size[k]
            if size[k] > SMALL or int(sig[a]) in self.long:
                self.long.add(int(sig[a]))
                self.parts.append((int(sig[a]), own[a:b]))
                drop[a + 1 : b] = True
        if last:
            few = at[(size > 1) & (size <= SMALL) & ~drop[np.minimum(at + 1, len(sig) - 1)]]
            sizes = size[np.searchsorted(at, few)]
            for d in range(1, SMALL):
                for f in range(d):
                    s = few[sizes > d]
                    self.pairs.append(np.stack([own[s + f], own[s + d]], 1))
        self.sigs, self.ids = [sig[~drop]], [own[~drop]]
        self.held = len(self.sigs[0])
        self.limit = max(BUFFER, 2 * self.held)

    def take(self) -> Iterator[pa.RecordBatch]:
        """What has been found since the last call; equal parts of a bucket are one."""
        pairs = np.unique(np.concatenate(self.pairs), axis=0) if self.pairs else np.zeros((0, 2), np.int64)
        parts = {k if self.split else m.tobytes(): (self.bucket << 32 | s, m) for k, (s, m) in enumerate(self.parts)}
        self.pairs, self.parts = [], []
        n = len(pairs)
        for k in range(0, n, 100_000):
            p = pairs[k : k + 100_000]
            none = pa.nulls(len(p))
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), none.cast(pa.int64()), none.cast(_RUNS.field(3).type)], schema=_RUNS)
        runs, members = [], []
        for run, m in parts.values():
            for k in range(1, len(m), BLOCK):
                runs.append(run)
                members.append(np.append(m[:1], m[k : k + BLOCK]))
        for k in range(0, len(runs), 2000):
            none = pa.nulls(len(runs[k : k + 2000])).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(runs[k : k + 2000], pa.int64()), pa.array(members[k : k + 2000], _RUNS.field(3).type)], schema=_RUNS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b), runs with their members, and of negative runs the nodes of a flush by place."""
    now: _Bucket | None = None
    for batch in batches:
        for bucket, flush, ids, sigs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if bucket < 0:
                none = pa.nulls(1).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([bucket], pa.int64()), pa.array([_unplanes(ids.as_py(), np.int64)], _RUNS.field(3).type)], schema=_RUNS)
                continue
            if now is None or now.bucket != bucket:
                if now:
                    now.cut(True)
                    yield from now.take()
                now = _Bucket(bucket)
            before = len(now.parts)
            now.add(_unplanes(sigs.as_py(), np.uint32), _unplanes(ids.as_py(), np.uint32).astype(np.int64) + (flush << FLUSH_BITS))
            if len(now.parts) > before:
                now.split = True
                yield from now.take()
    if now:
        now.cut(True)
        yield from now.take()


# ---- checks of pairs


def _fold(x: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return x


def may_link(na: int, sa: bytes, nb: int, sb: bytes) -> bool:
    """False only where sizes or sketches rule a link out."""
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    bits = 8 * min(len(sa), len(sb))
    x = _fold(int.from_bytes(sa, "little"), 8 * len(sa), bits) ^ _fold(int.from_bytes(sb, "little"), 8 * len(sb), bits)
    return 7 * x.bit_count() <= na + nb


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 x |both| >= 75 x |either|."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a)) and bool(len(b)) and 100 * both >= 75 * (len(a) + len(b) - both)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PAIR_DDL = "a long, b long"


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=_PAIR)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows with the ids, sizes and sketches of both."""
    for batch in batches:
        a, b, na, sa, nb, sb = (batch.column(k).to_pylist() for k in range(6))
        yield _pairs([(min(a[k], b[k]), max(a[k], b[k])) for k in range(len(a)) if a[k] != b[k] and may_link(na[k], sa[k], nb[k], sb[k])])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that link, from rows (a, part, b, text) by a and part, with a's own text, under b null, first."""
    key, centre = None, []
    for batch in batches:
        a, part, b = (batch.column(k).to_pylist() for k in range(3))
        sets = word_sets([t or b"" for t in batch.column(3).to_pylist()])
        out = []
        for k, s in enumerate(sets):
            if (a[k], part[k]) != key:
                key, centre = (a[k], part[k]), []
            if b[k] is None:
                centre.append(s)
            elif any(linked(s, c) for c in centre):
                out.append((a[k], b[k]))
        yield _pairs(out)


def _between(spanning: bool):
    """Pairs that may link, of different components and with a run in common, of each (centre, i, j) in a stream sorted by it; i = j or one of each block.

    All of them, or only as many as connect the components that all of them connect."""

    def group(rows: list[tuple]) -> list[tuple[int, int]]:
        found = []
        doc = np.array([r[0] for r in rows])
        _, root = np.unique([r[1] for r in rows], return_inverse=True)
        n = np.array([r[2] for r in rows])
        side = np.array([r[4] for r in rows])
        both = rows[0][6] != rows[0][5]
        mask = np.array([r[7] for r in rows], np.int64)
        by_bits: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by_bits.setdefault(len(r[3]), []).append(k)
        for bits, own in by_bits.items():
            words = bits // 8
            wide = own + by_bits.get(2 * bits, [])
            table = np.zeros((len(wide), words), np.uint64)
            for m, k in enumerate(wide):
                x = np.frombuffer(rows[k][3], np.uint64)
                table[m] = x if len(x) == words else x[:words] ^ x[words:]
            wide_at = np.array(wide)
            for m, k in enumerate(own):
                o = wide_at[m + 1 :]
                test = (root[o] != root[k]) & ((mask[o] & mask[k]) != 0) & (4 * np.minimum(n[o], n[k]) >= 3 * np.maximum(n[o], n[k]))
                if both:
                    test &= side[o] != side[k]
                hit = np.flatnonzero(test)
                if len(hit):
                    far = np.bitwise_count(table[m + 1 :][hit] ^ table[m]).sum(1, dtype=np.int64)
                    hit = o[hit[7 * far <= n[o[hit]] + n[k]]]
                    if spanning and len(hit):
                        merged, first = np.unique(root[hit], return_index=True)
                        hit = hit[first]
                        root[np.isin(root, merged)] = root[k]
                    found += [(min(a, b), max(a, b)) for a, b in zip(doc[hit].tolist(), [int(doc[k])] * len(hit), strict=True)]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for centre, i, j, doc, comp, n, sk, block, mask in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if (centre, i, j) != key:
                    if len(held) > 1:
                        yield _pairs(group(held))
                    held, key = [], (centre, i, j)
                held.append((doc, comp, n, sk, block, i, j, mask))
        if len(held) > 1:
            yield _pairs(group(held))

    return run


# ---- plans


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of documents, of pairs of nodes (a, b), that sizes and sketches let through."""
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("doc").alias(f"d{c}"), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"s{c}")), c)
    return pairs.select("da", "db", "na", "sa", "nb", "sb").mapInArrow(frugal(_sketched), _PAIR_DDL).distinct()


def _links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that link by their whole texts, of a written table; only texts of pairs are shuffled, and a's once a part of its partners."""
    parted = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int").alias("part"), "b")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = key_filter(ids.select(F.xxhash64("id").alias("h")), max(1, pairs.count()))
    some = may_repeat(texts, F.xxhash64("doc_id"), *held).filter("_may").select("_row.*")
    centres = parted.select("a", "part").distinct().join(some, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(None).cast("long").alias("b"), "raw")
    others = parted.join(some, F.col("b") == F.col("doc_id")).select("a", "part", "b", "raw")
    dealt = centres.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(frugal(_checked), _PAIR_DDL).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _members(parts: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """centre, doc, n, node, mask: the members of long runs by the runs' smallest id; mask has a bit for each run, by hash."""
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(run), 64) as int))")
    held = parts.select(F.element_at("members", 1).alias("centre"), bit.alias("bit"), F.explode("members").alias("id")).groupBy("centre", "id").agg(F.bit_or("bit").alias("mask"))
    held = held.join(named, "id").groupBy("centre", "node").agg(F.bit_or("mask").alias("mask"))
    return held.join(nodes.select("node", "doc", "n"), "node").select("centre", "doc", "n", "node", "mask")


def _crowds(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows for _between(): the members of centres that are in several components, dealt by pair of blocks."""
    held = members.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    mixed = held.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("lo < hi")
    left = held.join(written(mixed.select("centre", "blocks")), "centre").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.join(nodes.select("node", "doc", "fine"), ["node", "doc"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "component", "n", "fine", "block", "mask")
    return left.repartition("centre", "i", "j").sortWithinPartitions("centre", "i", "j", "doc")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    bounded_batches(df)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    first = written(texts.mapInArrow(frugal(_sets), _SETS_DDL))
    sets = first.filter("page is null").select("doc_id", "n", "key", "node", "fine")
    total = sets.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    least = max(FREQUENT, CROWDED * int(total["n"]) // CELLS)
    pages = first.filter("page is not null").select("page", "counts").repartition("page").sortWithinPartitions("page")
    found = pages.mapInArrow(frugal(_marks(least)), "page int, bits binary").collect()  # CELLS / 8 bytes at most
    marks = bytearray(CELLS // 8) if found else None
    for r in found:
        marks[r["page"] * (PAGE_CELLS // 8) : (r["page"] + 1) * (PAGE_CELLS // 8)] = r["bits"]

    full = sets.filter("n > 0 and doc_id is not null")
    nodes = written(full.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("node").alias("node"), F.first("fine").alias("fine")))
    bits = min(24, max(10, (int(total["n"]) // 65536).bit_length()))
    blobs = texts.filter("doc_id is not null").select("raw").mapInArrow(frugal(_sign(bits, bytes(marks) if marks else None)), "bucket long, flush long, ids binary, sigs binary")
    runs = written(blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_runs), _RUNS_DDL))
    named = runs.filter("run < 0").select((-1 - F.col("run")).alias("flush"), F.posexplode("members").alias("at", "node")).select((F.shiftleft("flush", FLUSH_BITS) + F.col("at")).alias("id"), "node")
    parts = runs.filter("run >= 0")
    star = parts.select(F.explode(F.slice("members", 2, BLOCK)).alias("b"), F.element_at("members", 1).alias("a")).select("a", "b")
    pairs = runs.filter("run is null").select("a", "b").unionByName(star).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(named.select(F.col("id").alias(c), F.col("node").alias(f"n{c}")), c).drop(c)
    pairs = pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).filter("a <> b").distinct()
    same = nodes.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("node").alias("a"), F.col("node").alias("b"))
    near = written(_near(pairs.unionByName(same), nodes))

    members = written(_members(parts, named, nodes))
    links = written(_links(texts, written(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))))
    labels = connected(links)
    for spanning in (True, False):
        more = _crowds(members, nodes, labels).mapInArrow(frugal(_between(spanning)), _PAIR_DDL)
        rest = written(_apart(near.unionByName(more) if spanning else more, labels).distinct())
        links = written(links.unionByName(_links(texts, rest)))
        labels = connected(links)

    classes = nodes.join(labels, F.col("doc") == labels["node"], "left").select(F.hex("key").alias("key"), "copies", F.coalesce("component", "doc").alias("component_id"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.hex("key")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    out = join_groups(rows, classes, "key", "copies", total["rows"], "doc_id")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a smaller doc_id."""
    return without(docs, components(docs, id_col, text_col).filter("component_id < doc_id").select(F.col("doc_id").alias("_id")), id_col)
