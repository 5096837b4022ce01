"""Cost-balanced packing of documents into sequences of at most SEQUENCE tokens.

A document is its ids and then END. It is cut into whole sequences from its start, which need no padding; what is left goes to a bin of
about BIN_DOCS documents dealt by hash. In a bin there are ceil(tokens / SEQUENCE) sequences; pieces in descending order of
estimated cost (LINEAR x length + QUADRATIC x length^2, the attention cost) go to the sequence of lowest cost that still has
room for the whole piece. Pieces that fit nowhere whole are then cut, largest first, to fill the emptiest sequences, so a bin
pads its last sequence only: under SEQUENCE / (tokens of a bin), about 0.1 %. The bin's unfilled sequence is one, by moving what the
least full ones hold.

Remainders travel as 16-bit ids where these suffice, so the shuffle moves about two bytes a token of what is left over.

Null and empty text give the one id END. A very long text is cut into whole sequences like any other, and only its remainder is shuffled. Rows repeated with one
doc_id, null included, are packed each on its own: bins are dealt by doc_id and ids, and of equal rows by the SAME-th of a task, so that no bin
grows with the copies of one row. Ties in cost go to the row that a bin has first, by doc_id, tokens and hash, and to its first sequence. An
empty table gives no rows. Other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal

SEQUENCE = 2048
END = 1
BIN_DOCS = 4096
SAME = 64  # equal rows of a task that share a bin
#: The split of the byte-level vocabulary; possessive, so that it runs in linear time.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost(length: np.ndarray | int):
    """Linear (projections) and quadratic (attention) work of a piece."""
    return LINEAR * length + QUADRATIC * length * length


class Ids:
    """Token ids of texts, little-endian 32-bit.

    The merges are those of the tokenizer file at path, run by tiktoken, which gives the same ids several times faster;
    tests hold the two against each other. The file's added tokens stand for themselves wherever their strings occur in a text, the
    longest of those at the leftmost place; what lies between them is encoded on its own.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        byte = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(byte[c] for c in word): k for word, k in vocab.items() if all(c in byte for c in word)}
        self.ordinary = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if bad := [t for t in file.get("added_tokens") or [] if t["single_word"] or t["lstrip"] or t["rstrip"]]:
            raise ValueError(f"added tokens that match words or take white space are not supported: {bad}")
        self.added = {t["content"]: t["id"] for t in file.get("added_tokens") or []}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encode(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):
            return self.ordinary(text)
        return [k for n, part in enumerate(self.cut.split(text)) for k in ([self.added[part]] if n % 2 else self.ordinary(part))]

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype="<u4")


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One tokenizer a worker process and file."""
    return Ids(path)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or one past U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_DOC = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("whole_crc", pa.list_(pa.int64())), ("rest", pa.binary()), ("salt", pa.int64())])


def _tokenize(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = ids_of(path)
        end = np.array([END], dtype="<u4")
        task = TaskContext.get().partitionId() + 1
        seen: Counter[tuple[int | None, int, int]] = Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[list] = [[] for _ in _DOC]
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = np.concatenate([ids(text.as_py() or ""), end])
                    n = len(own)
                    full = n // length
                    crc = [zlib.crc32(own[length * k : length * (k + 1)].tobytes()) for k in range(full)]
                    rest = own[length * full :]
                    name = (i, n, zlib.crc32(own.tobytes()))
                    seen[name] += 1
                    turn = (seen[name] - 1) // SAME
                    for column, value in zip(out, (i, n, crc, rest.astype("<u2").tobytes() if not len(rest) or rest.max() < 65536 else b"\xff" + rest.tobytes(), turn and task << 32 | turn), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _DOC, strict=True)], schema=_DOC)

    return run


def _ids(rest: bytes) -> np.ndarray:
    """An odd number of bytes marks 32-bit ids."""
    return np.frombuffer(rest, "<u4", offset=1) if len(rest) % 2 else np.frombuffer(rest, "<u2").astype("<u4")


def place(lengths: list[int], length: int = SEQUENCE) -> list[list[tuple[int, int, int, int]]]:
    """For each piece its parts (start in the piece, length, sequence, offset there)."""
    n = math.ceil(sum(lengths) / length)
    room = np.full(n, length)
    spent = np.zeros(n)
    used = [0] * n
    parts: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    late = []

    def put(k: int, start: int, size: int, s: int) -> None:
        parts[k].append((start, size, s, used[s]))
        used[s] += size
        room[s] -= size
        spent[s] += cost(size)

    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        size = lengths[k]
        if not size:
            continue
        s = int(np.where(room >= size, spent, np.inf).argmin())
        if room[s] >= size:
            put(k, 0, size, s)
        else:
            late.append(k)
    open_ = [s for s in np.argsort(-room, kind="stable").tolist() if room[s]]  # emptiest first
    at = 0
    for k in late:
        start = 0
        while start < lengths[k]:
            s = open_[at]
            size = min(int(room[s]), lengths[k] - start)
            put(k, start, size, s)
            start += size
            at += not room[s]
    # Of the sequences that are still open all but one are filled from the emptiest one's end.
    left = [s for s in range(n) if room[s]]
    if len(left) > 1:
        holds: dict[int, list[list]] = {s: [] for s in left}
        for k, own in enumerate(parts):
            for p in own:
                if p[2] in holds:
                    holds[p[2]].append([p[3], k, p])
        left.sort(key=lambda s: (int(room[s]), s))
        stacks = {s: sorted(holds[s]) for s in left}
        i, j = 0, len(left) - 1
        while i < j:
            to, frm = left[i], left[j]
            if not room[to]:
                i += 1
                continue
            if not stacks[frm]:
                j -= 1
                continue
            _, k, p = stacks[frm].pop()
            size = min(int(room[to]), p[1])
            parts[k].remove(p)
            if size < p[1]:
                kept = (p[0], p[1] - size, frm, p[3])
                parts[k].append(kept)
                stacks[frm].append([p[3], k, kept])
            parts[k].append((p[0] + p[1] - size, size, to, used[to]))
            used[to] += size
            room[to] -= size
            used[frm] -= size
            room[frm] += size
    return parts


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(length: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "doc_tokens", "order"], kind="stable", na_position="last")
        first = int(key[0]) << 32
        out = []
        for i, tokens, crcs in zip(rows["doc_id"], rows["doc_tokens"], rows["whole_crc"], strict=True):
            for k, crc in enumerate(crcs):
                out.append((i, k * length, length, crc, tokens, first, 0))
                first += 1
        rest = [_ids(x) for x in rows["rest"]]
        for i, tokens, ids, own in zip(rows["doc_id"], rows["doc_tokens"], rest, place([len(x) for x in rest], length), strict=True):
            for start, size, s, offset in sorted(own):
                out.append((i, tokens - len(ids) + start, size, zlib.crc32(ids[start : start + size].tobytes()), tokens, first + s, offset))
        out = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack(df: DataFrame, tokenizer: str, length: int = SEQUENCE, bin_docs: int = BIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    bounded_batches(df)
    bins = max(1, math.ceil(df.count() / bin_docs))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(_tokenize(tokenizer, length)), "doc_id long, doc_tokens long, whole_crc array<long>, rest binary, salt long")
    order = F.xxhash64("doc_id", "rest", "whole_crc")
    dealt = docs.withColumn("order", order).withColumn("bin", F.pmod(F.xxhash64(F.lit(7), "order", "salt"), F.lit(bins)))
    return dealt.groupBy("bin").applyInPandas(_pack(length), _PIECES)
