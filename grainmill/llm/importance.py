"""Importance resampling towards a target distribution by an external sort-count of feature buckets.

Features are runs of up to `runs` consecutive words; a feature's bucket is its CRC-32 modulo BUCKETS. Tasks write the buckets of their
documents as packed uint16 streams, a block of documents a row, with the place where each document ends. To count, each block is
sorted and run-length encoded, and the runs, BUCKETS a task at most, are summed by bucket. A bucket's gain is the scaled log
ratio of its smoothed shares in the target and in the corpus; the table of gains has BUCKETS entries whatever the data. A second pass over
the streams gathers gains and adds them by document with np.add.reduceat; texts are read once.

A document's score is the floored mean of its features' gains plus Gumbel noise from a hash of its id, so the highest scores are a sample
without replacement. The lowest score drawn comes from a histogram of scores, whole numbers in a range that double
precision bounds; rows from it upwards are ordered by ranges of score and id, and a row's rank is its place in its range plus
the rows of ranges before it. No task orders all rows.

Null and empty texts, and texts without words, have no features and weight 0; they get a score and are not drawn, as they have too few words.
A text of any length is one document of one block; its words are cut out a piece at a time. A null id hashes as an empty one and comes after other ids in ties.
Rows that share an id are documents of their own, and of equal ones any may have the lower rank. An empty table gives no rows; an empty target only has
smoothed shares. Other columns, of whatever name, are ignored by resample(), and carried along by drawn_rows().
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, written

BUCKETS = 10_000
SCALE = 1000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: A block of documents ends after so many features or documents; PIECE bytes of a text are cut into words at a time.
BLOCK_FEATURES, BLOCK_DOCS, PIECE = 1 << 20, 10_000, 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # other bytes are ASCII and separate; capitals are lower-cased before
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def buckets(text: bytes, runs: int = 1) -> tuple[np.ndarray, int]:
    """(buckets of the text's features as uint16, its number of words)."""
    parts, n, tail = [], 0, []
    for piece in _pieces(text):
        words = _WORD.findall(piece.lower())
        n += len(words)
        parts.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        for k in range(2, runs + 1):
            near = tail[max(0, len(tail) - k + 1) :] + words
            grams = [b" ".join(near[i : i + k]) for i in range(len(near) - k + 1)]
            parts.append(np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)))
        tail = (tail + words)[-runs:] if runs > 1 else tail
    return (np.concatenate(parts) % BUCKETS).astype("<u2"), n


def streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 1) -> DataFrame:
    """ids, words, ends (the number of features up to and with each document) and stream (packed uint16 buckets) of blocks of documents."""
    import pyarrow as pa

    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        ids, words, ends, stream, features = [], [], [], [], 0

        def block():
            return pa.RecordBatch.from_pydict({"ids": pa.array([ids], out_type), "words": [words], "ends": [ends], "stream": [np.concatenate(stream).tobytes()]})

        for batch in batches:
            out_type = pa.list_(batch.schema.field(0).type)
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                one, n = buckets(text.as_py() or b"", runs)
                ids.append(doc.as_py())
                words.append(n)
                stream.append(one)
                features += len(one)
                ends.append(features)
                if features >= BLOCK_FEATURES or len(ids) >= BLOCK_DOCS:
                    yield block()
                    ids, words, ends, stream, features = [], [], [], [], 0
        if ids:
            yield block()

    bounded_batches(df)
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(frugal(run), f"ids array<{id_type}>, words array<long>, ends array<long>, stream binary")


def counts(blocks: DataFrame) -> DataFrame:
    """bucket, n of the streams."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")  # a radix sort for 16 bits
                starts = np.flatnonzero(np.diff(ordered, prepend=-1)) if len(ordered) else np.zeros(0, int)
                yield pa.RecordBatch.from_pydict({"bucket": ordered[starts].astype(np.int32), "n": np.diff(starts, append=len(ordered)).astype(np.int64)})

    return blocks.select("stream").mapInArrow(frugal(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from counts() of both sides: BUCKETS rows at most each."""
    sides = []
    for side in (corpus, target):
        n = [0] * BUCKETS
        for r in side.collect():
            n[r["bucket"]] = r["n"]
        sides.append((n, sum(n)))
    (s, all_s), (t, all_t) = sides
    ratio = [(float(t[b] + 1) * float(all_s + BUCKETS)) / (float(s[b] + 1) * float(all_t + BUCKETS)) for b in range(BUCKETS)]
    return np.array([math.floor(SCALE * math.log(r)) for r in ratio], dtype=np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document of the streams."""
    import pyarrow as pa

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for ids, words, ends, stream in zip(*batch.columns, strict=True):
                to = np.asarray(ends.values, dtype=np.int64)
                n = np.diff(to, prepend=0)
                full = np.flatnonzero(n)
                weight = np.zeros(len(n), dtype=np.int64)
                if len(full):
                    found = gain[np.frombuffer(stream.as_buffer(), "<u2")]
                    weight[full] = np.add.reduceat(found, (to - n)[full]) // n[full]
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.select("ids", "words", "ends", "stream").mapInArrow(frugal(run), f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise, scaled and floored, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored with rank: 1, 2, ... of the rows drawn, by falling score and then id; null for others."""
    spark = scored.sparkSession
    fits = F.col("n_words") >= least_words
    levels = scored.filter(fits).groupBy("score").agg(F.count("*").alias("n"))
    # Scores are whole numbers between bounds of double precision (about 2 * 10^5 values), so this window sees no more rows than that.
    from_top = F.sum("n").over(Window.orderBy(F.desc("score")))
    drawn = F.expr(f"(sum(n) OVER () * {int(percent)}) div 100")
    edge = levels.select("score", "n", from_top.alias("to"), drawn.alias("k")).filter("to - n < k").agg(F.min("score").alias("edge"), F.max("k").alias("k")).first()
    none = F.lit(None).cast("long").alias("rank")
    if edge["k"] is None:
        return scored.select("*", none)
    near = fits & (F.col("score") >= edge["edge"])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.asc("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(scored.filter(near).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("part").alias("_part"), (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.col("_before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    met = dealt.join(F.broadcast(before), F.col("part") == F.col("_part")).withColumn("_r", place)
    top = met.select(*scored.columns, F.when(F.col("_r") <= edge["k"], F.col("_r")).cast("long").alias("rank"))
    return top.unionByName(scored.filter(~near).select("*", none))


def _scored(df: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, runs: int, seed: int) -> DataFrame:
    blocks = written(streams(df, id_col, text_col, runs))
    aim = target.select(F.lit(0).alias("id"), F.col(target_text).alias("text"))
    gain = gains(counts(blocks), counts(streams(aim, "id", "text", runs)))
    out = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return written(out.withColumn("row", F.monotonically_increasing_id()))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", runs: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words of every row of df; rank is null where the row is not drawn."""
    scored = _scored(df, target, id_col, text_col, target_text, runs, seed)
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """The rows of docs whose id is drawn; rows that share an id go together."""
    found = resample(docs, target, id_col, **kwargs).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")


_CRC = "list_reduce({bytes}, lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, _: xor(v >> 1, 3988292384 * (v & 1))), 4294967295)"


def _codes(text: str) -> str:
    """SQL of the UTF-8 bytes of a text as a list of numbers."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"


def sql() -> str:
    """DuckDB SQL of resample() over documents and benchmark; CRC-32 is folded over the bytes of each distinct word, bit by bit."""
    crc = f"xor({_CRC.format(bytes=_codes('w'))}, 4294967295)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY rid, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY w),
k AS (SELECT w, ({crc}) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, sum(n) AS s FROM dw JOIN k USING (w) GROUP BY b),
t AS (SELECT b, sum(n) AS t FROM bw JOIN k USING (w) GROUP BY b),
g AS (SELECT b, floor({SCALE} * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE)
  / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
m AS (SELECT rid, sum(n * gain) AS total, sum(n) AS n FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY rid),
f AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_features,
  CASE WHEN n IS NULL THEN 0 ELSE ((total - ((total % n) + n) % n) // n) END::BIGINT AS weight,
  ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rid)),
c AS (SELECT *, (weight + floor(-{SCALE} * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS r,
  {PERCENT} * count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) // 100 AS k FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= k THEN r END AS rank, n_features AS n_words FROM o"""
