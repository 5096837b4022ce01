"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are added as logarithms: the text's likelihood under byte-trigram models, the declared markup language,
the address suffix, and the prior of the host, smoothed by its suffix's prior, itself smoothed by that of the whole table. Priors and the
likelihood of a declaration given a language come from grouped aggregation over all rows, counting each row's best language
by text; a row's own vote is taken out of its host's and suffix's counts. The text counts for at most EVIDENCE trigrams, so that other evidence keeps a say in long
texts too.

The trigram models are fitted on at most SAMPLE labelled rows a language, those with the smallest hash of their id, for every
language that a label names; labels count by their base code, so "EN" and "en-US" are "en". Their trigrams are counted on executors, and
only counts, 0.26 MB a language whatever the texts' length, come to the driver. A declaration
of a language that no label names has no model to be judged by. identify() rejects a row without letters, and one that is declared as another language than that
found with probability SURE by all evidence, with MARGIN nats to the next, and by the text alone; the rest are accepted.

Null or empty text gives no text evidence: the priors decide. Null declaration, suffix or host adds nothing. Ties go to the first
language by name. Repeated rows each count. An empty table gives no rows; without labelled rows the language is null.
Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, join_groups, unit_hash, written
from .exact_dedup import without

SAMPLE = 300
SLOTS = 1 << 16
EVIDENCE = 60
STRENGTH = 20.0
SURE, MARGIN = 0.999, 20.0
_FOLD = np.full(256, 32, dtype=np.uint8)
for _c in range(256):
    if 97 <= _c <= 122 or _c >= 128:
        _FOLD[_c] = _c
    elif 65 <= _c <= 90:
        _FOLD[_c] = _c + 32


def trigrams(text: bytes) -> np.ndarray:
    """Slots of the text's byte trigrams; A-Z fold to lower case, other ASCII to spaces, and trigrams of one space repeated go."""
    b = _FOLD[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))] if len(code) else code
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def counts_of(texts: list[str | bytes | None]) -> np.ndarray:
    """Trigrams of the texts by slot."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    for text in texts:
        raw = text.encode() if isinstance(text, str) else text or b""
        for part in _parts(raw):
            counts += np.bincount(trigrams(part), minlength=SLOTS)
    return counts


def _parts(raw: bytes, size: int = 1 << 20) -> list[bytes]:
    """A text in pieces of a bounded size; trigrams across a cut are counted as at an end."""
    return [raw[k : k + size] for k in range(0, max(1, len(raw)), size)]


def fit(counts: list[tuple[str, np.ndarray]]) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probability of each slot in each, by add-one-half smoothing, from (language, trigrams by slot)."""
    counts = sorted(counts, key=lambda x: x[0])
    table = np.empty((SLOTS, len(counts)), dtype=np.float32)
    for k, (_, own) in enumerate(counts):
        table[:, k] = np.log((own + 0.5) / (own + 0.5).sum())
    return [lang for lang, _ in counts], table


def base_code(label: Column) -> Column:
    """The lower-case language of a label such as "en-US" or "EN_gb"; null where none is named."""
    code = F.regexp_extract(F.lower(F.trim(label)), "^[^-_]*", 0)
    return F.when(code != "", code)


_COUNTS = pa.schema([("lang", pa.string()), ("counts", pa.binary())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, trigrams by slot) of rows (language, text) in the order of their language."""
    now, counts = None, np.zeros(SLOTS, np.int64)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([counts.astype("<u4").tobytes()], pa.binary())], schema=_COUNTS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if lang != now:
                if now is not None:
                    yield done()
                now, counts = lang, np.zeros(SLOTS, np.int64)
            counts += counts_of([text.as_py()])
    if now is not None:
        yield done()


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray]]:
    """Trigram counts of at most SAMPLE rows of each language."""
    known = labelled.select(F.col(id_col).alias("_id"), base_code(F.col(lang_col)).alias("_lang")).filter("_lang is not null and _id is not null")
    rates = known.groupBy("_lang").agg(F.least(F.lit(1.0), F.lit(4.0 * SAMPLE) / F.count("*")).alias("_rate"))  # few candidates leave a task
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    few = known.join(F.broadcast(rates), "_lang").filter(unit_hash(F.col("_id")) < F.col("_rate")).withColumn("_rank", rank).filter(F.col("_rank") <= SAMPLE).select("_id", "_lang").distinct()
    rows = labelled.select(F.col(id_col).alias("_id"), base_code(F.col(lang_col)).alias("_lang"), F.col(text_col).alias("_text")).filter("_lang is not null")
    rows = rows.join(F.broadcast(few), ["_id", "_lang"], "left_semi").dropDuplicates(["_id", "_lang"]).select("_lang", F.coalesce("_text", F.lit("")).cast("binary").alias("_text"))  # at most SAMPLE a language
    counted = rows.repartition("_lang").sortWithinPartitions("_lang").mapInArrow(frugal(_counted), "lang string, counts binary")
    return [(r["lang"], np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in counted.collect()]


_SCORED = "id long, declared string, host string, suffix string, n long, ll array<float>, top int"
_SCHEMA = pa.schema([("id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("suffix", pa.string()), ("n", pa.int64()), ("ll", pa.list_(pa.float32())), ("top", pa.int32())])


_OPEN = re.compile(rb"<(script|style)\b[^<>]*>", re.IGNORECASE)
_CLOSE = {name: re.compile(rb"</" + name + rb"\b[^<>]*>", re.IGNORECASE) for name in (b"script", b"style")}
_TAG = re.compile(rb"<[^<>]*>|&[a-zA-Z0-9#]+;")


def visible(html: bytes) -> bytes:
    """What stands between tags, outside scripts and style sheets; one that is never closed hides all that follows."""
    out, at = [], 0
    while m := _OPEN.search(html, at):
        out.append(html[at : m.start()])
        closed = _CLOSE[m[1].lower()].search(html, m.end())
        at = closed.end() if closed else len(html)
    out.append(html[at:])
    return _TAG.sub(b" ", b" ".join(out))


def _score(table: np.ndarray, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ll, top = [], [], []
            for text in batch.column(4):
                raw = text.as_py() or b""
                score, size = np.zeros(table.shape[1], dtype=np.float32), 0
                for part in _parts(visible(raw) if markup else raw):
                    t = trigrams(part)
                    size += len(t)
                    for k in range(0, len(t), 1 << 16):
                        score += table[t[k : k + (1 << 16)]].sum(0, dtype=np.float64)
                n.append(size)
                ll.append(score.tolist())
                top.append(int(score.argmax()) if size else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(_SCHEMA.field(k).type) for k in range(4)), pa.array(n, pa.int64()), pa.array(ll, _SCHEMA.field("ll").type), pa.array(top, pa.int32())], schema=_SCHEMA)

    return run


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12)))


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, markup: bool = False) -> DataFrame:
    """id, language, probability, text_language, declared, host, suffix, n_trigrams, accepted, reason of every row; of markup, the text between tags."""
    names, table = model
    none = F.lit(None).cast("string")
    if not names:
        return df.select(F.col(id_col).cast("long").alias("id"), none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"), (none if declared is None else declared).alias("declared"), (none if host is None else host).alias("host"), (none if suffix is None else suffix).alias("suffix"), F.lit(0).cast("long").alias("n_trigrams"), F.lit(True).alias("accepted"), none.alias("reason"))
    parts = df.select(F.col(id_col).cast("long").alias("id"), *((none if c is None else c).cast("string").alias(k) for k, c in (("declared", declared), ("host", host), ("suffix", suffix))), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    bounded_batches(df)
    rows = written(parts.mapInArrow(frugal(_score(table, markup)), _SCORED))
    votes = [F.count(F.when(F.col("top") == k, 1)) for k in range(len(names))]
    whole = rows.agg(F.count("*").alias("rows"), *(v.alias(f"v{k}") for k, v in enumerate(votes))).first()
    total = whole["rows"]
    seen = sum(whole[f"v{k}"] for k in range(len(names)))
    share = [(whole[f"v{k}"] + 1) / (seen + len(names)) for k in range(len(names))]
    for key in ("suffix", "host", "declared"):
        counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(f"{key}_rows"), F.array(*votes).alias(f"{key}_votes"))
        rows = join_groups(rows, written(counts), key, f"{key}_rows", total, "id")  # a small table is joined without a shuffle
    out = rows
    own = [(F.col("top") == k).cast("int") for k in range(len(names))]
    own = [F.coalesce(o, F.lit(0)) for o in own]
    voted = F.when(F.col("top").isNull(), 0).otherwise(1)

    def counted(key: str, k: int) -> Column:
        return F.coalesce(F.col(f"{key}_votes")[k] - own[k], F.lit(0)).cast("double")

    def sized(key: str) -> Column:
        held = F.aggregate(F.col(f"{key}_votes"), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.coalesce(held - voted, F.lit(0)).cast("double")

    out = out.withColumns({"_ns": sized("suffix"), "_nh": sized("host")})
    logs = []
    for k in range(len(names)):
        by_suffix = (counted("suffix", k) + STRENGTH * share[k]) / (F.col("_ns") + STRENGTH)
        by_host = (counted("host", k) + STRENGTH * by_suffix) / (F.col("_nh") + STRENGTH)
        said = F.when(F.col("declared").isNull() | F.col("declared_votes").isNull(), 0.0).otherwise(_log((F.col("declared_votes")[k] + 0.5) / F.lit(float(whole[f"v{k}"] + 1))))
        heard = F.when(F.col("n") > 0, F.col("ll")[k].cast("double") * F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.col("n"))).otherwise(0.0)
        logs.append(_log(by_host) + said + heard)
    out = out.withColumn("_logs", F.array(*logs)).withColumn("_best", F.array_max("_logs"))
    out = out.withColumn("_at", F.array_position("_logs", F.col("_best")).cast("int"))
    out = out.withColumn("probability", 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_best"))))
    heard = [F.col("ll")[k].cast("double") for k in range(len(names))]
    out = out.withColumn("_text", F.array(*heard)).withColumn("_margin", F.array_max("_text") - F.coalesce(F.expr("try_element_at(sort_array(_text, false), 2)"), F.lit(-1e9)))
    name = F.array(*map(F.lit, names))
    language, text_language = F.element_at(name, F.col("_at")), F.when(F.col("top").isNotNull(), F.element_at(name, F.col("top") + 1))
    base = base_code(F.col("declared"))
    other = F.col("declared").isNotNull() & base.isin(names) & (base != language) & (base != text_language) & (F.col("probability") >= SURE) & (F.col("_margin") >= MARGIN) & (language == text_language)
    reason = F.when(F.col("n") == 0, "no letters").when(other, "declared otherwise")
    return out.select("id", language.alias("language"), F.round("probability", 6).alias("probability"), text_language.alias("text_language"), "declared", "host", "suffix", F.col("n").alias("n_trigrams"), reason.isNull().alias("accepted"), reason.alias("reason"))


def page_evidence() -> dict:
    """text, declared language, host and suffix of pages with url and html."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", F.regexp_replace(host, r"^(?:www|m)\.", ""))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([a-z]{2,3})", 1))
    return {"text": F.col("html"), "markup": True, "declared": F.when(declared != "", declared), "host": host, "suffix": F.substring_index(host, ".", -1)}


def accepted_rows(docs: DataFrame) -> DataFrame:
    """The documents that identify() accepts, their source standing for the host and lang for the declaration."""
    found = identify(docs, fit(sample(docs, "doc_id", "text", "lang")), "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    return without(docs, found.filter(~F.col("accepted")).select(F.col("id").alias("_id")))
