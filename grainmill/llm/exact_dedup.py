"""Exact dedup by two passes over Bloom filters: only rows that may be repeated are shuffled.

Pass one is a Bloom filter of one hash with SEEN_BITS bits a row, kept as 64-bit words. Each task builds the words of its own
rows; words are merged by OR, and the number of rows that set a word against the bits set in it shows a carry: two
rows on one bit. At that width few words hold two rows that differ, and what moves is at most a word and a count a row, less
where a task fills words; a dense bitmap a task would be larger. Words with a carry make the second filter. Pass two tests
each row's word: rows that fail have no equal and go straight through; the others are grouped by the SHA-256 of their text.

Filters are pages of PAGE bits; a key has a page and two bits in it, so a test is one join with a broadcast of at most
FILTER_BITS bits (32 MB). Past that size a filter lets more rows through and none is lost.

Null text counts as empty, and empty texts are equal to each other. Very long texts count by their hash as others do; only exact_dedup's
digests, never texts, are grouped. Rows repeated with one doc_id and one text are one document: exact_dedup() gives all of them one
verdict, keep_rows() keeps one of them. A null doc_id stays only where the whole group has none. An empty table gives no rows.
Other columns, of whatever name, are carried along by keep_rows() and ignored by exact_dedup().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, written

SEEN_BITS = 256
FILTER_BITS = 1 << 28
PAGE = 32768  # bits of one page made by bitmap_construct_agg


def _power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def key_filter(keys: DataFrame, rows: int, bits_a_key: int = 16) -> tuple[DataFrame, int]:
    """(pages, their number) of a Bloom filter of the column h of keys."""
    pages = min(FILTER_BITS, _power(bits_a_key * max(rows, 1)) - 1) // PAGE + 1
    h = F.col("h")
    spots = F.explode(F.array(*(F.pmod(F.xxhash64(h, F.lit(k)), F.lit(PAGE)) for k in (2, 3))))
    place = keys.select(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(pages)).alias("_page"), spots.alias("_spot"))
    return place.groupBy("_page").agg(F.bitmap_construct_agg("_spot").alias("_bits")), pages


def may_repeat(df: DataFrame, h: Column, held: DataFrame, pages: int) -> DataFrame:
    """df's rows as a struct _row, and _may: whether the hash h of a row passes the filter."""
    out = df.select(F.struct(*df.columns).alias("_row"), h.alias("_h"))
    out = out.withColumn("_at", F.pmod(F.xxhash64("_h", F.lit(1)), F.lit(pages))).join(F.broadcast(held), F.col("_at") == F.col("_page"), "left")
    test = F.lit(True)
    for k in (2, 3):
        spot = f"pmod(xxhash64(_h, {k}), {PAGE})"
        test &= F.expr(f"bit_get(cast(conv(hex(substring(_bits, cast({spot} div 8 + 1 as int), 1)), 16, 10) as long), cast({spot} % 8 as int)) = 1")
    return out.select("_row", F.coalesce(test, F.lit(False)).alias("_may"))


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(words))


def repeated_words(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(h: the words of the first filter in which two rows meet on one bit, the number of words) of a column named h."""
    words = _power(SEEN_BITS * max(rows, 1) // 64)
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    merged = hashes.select(_word(F.col("h"), words).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"), F.count("*").alias("n"))
    return merged.filter(F.col("n") > F.bit_count("set")).select(F.col("word").alias("h")), words


def tested(df: DataFrame, h: Column, hashes: DataFrame, rows: int) -> DataFrame:
    """df's rows as _row, with _may: whether hashes (a column h of each row's hash) holds the row's hash twice, or may."""
    twice, words = repeated_words(hashes, rows)
    return may_repeat(df, _word(h, words), *key_filter(twice, rows // 4))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less those whose id is in the column _id of gone; rows that a Bloom filter of gone rules out are not shuffled."""
    gone = written(gone.select("_id").distinct())
    flagged = may_repeat(docs, F.xxhash64(F.col(id_col)), *key_filter(gone.select(F.xxhash64("_id").alias("h")), gone.count()))
    kept = flagged.filter("_may").join(gone, F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id")), "left_anti")
    return flagged.filter("not _may").select("_row.*").unionByName(kept.select("_row.*"))


def _slim(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    text = normal(F.col(text_col))
    slim = written(df.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("h")))
    return slim, slim.count()


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    slim, rows = _slim(df, id_col, text_col)
    flagged = tested(slim, F.col("h"), slim.select("h"), rows)
    alone = flagged.filter("not _may").select("_row.doc_id", F.col("_row.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_row.text_sha256")
    maybe = flagged.filter("_may").select("_row.doc_id", "_row.text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = join_groups(maybe, groups, "text_sha256", "group_size", rows, "doc_id")
    found = found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(found)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops, and one row where equal texts share the doc_id that stays.

    Texts that no filter lets through are not shuffled. Of the others, the row that stays is known by its digest and doc_id; where several rows
    have both, the one of the smallest hash of all its columns stays, or of equal rows one.
    """
    slim, rows = _slim(docs, id_col, text_col)
    maybe = tested(slim, F.col("h"), slim.select("h"), rows).filter("_may").select("_row.*")
    named = maybe.groupBy("text_sha256", "doc_id").agg(F.count("*").alias("times"))
    stay = named.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "times")).alias("k")).select(F.col("text_sha256").alias("_s"), F.col("k.doc_id").alias("_d"), F.col("k.times").alias("_times"))
    flagged = tested(docs, F.xxhash64(normal(F.col(text_col))), slim.select("h"), rows)
    passed = flagged.filter("_may").select("_row", F.sha2(normal(F.col(f"_row.`{text_col}`")), 256).alias("_sha"), F.col(f"_row.`{id_col}`").alias("_id"))
    met = passed.join(stay, (F.col("_sha") == F.col("_s")) & F.col("_id").eqNullSafe(F.col("_d")))  # dealt by both, so that a hot text is spread
    one = met.filter("_times = 1").select("_row.*")
    several = met.filter("_times > 1").groupBy("_sha").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return flagged.filter("not _may").select("_row.*").unionByName(one).unionByName(several)
