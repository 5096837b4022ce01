"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule names a ratio of two signals and its least and greatest allowed value. compiled() turns a table of rules into columns: what
a rule finds, and whether a text breaks it. Signals are counts of one text: words, their characters, symbols, stop words, lines, repeated
lines, and words in runs of three that occur again. No row meets another, so nothing is shuffled, and no user function is called.

Words are runs without space, tab, line feed, vertical tab, form feed or carriage return; case and punctuation count. Runs of three
are sorted inside their text by hash; those that meet a neighbour are sorted and compared as they are written, so
a text of n words costs n log n whatever it repeats, and no hash decides.

Null or empty text has no words, all its signals are 0 and it fails. Texts of any length are read whole. Repeated rows get equal
results, ties do not occur, an empty table gives no rows, a null id stays null. quality() ignores all other columns; keep_rows() carries them
along, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Least words, and greatest share in percent of words in repeated runs of RUN words, of any text.
LEAST_WORDS, MOST_REPEATED, RUN = 50, 50, 3
#: Hashes of runs keep their place in the lower bits, more than an array can have.
PLACE = 1 << 31

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by this are at from have has not or an you he she they we "
    "de la le et les des en un du une que pour est qui dans par pas au sur avec ce il ne se plus "
    "der die und den von zu das sich mit auf für ist nicht im dem ein eine als auch es an werden aus "
    "el y los del las por no con su para al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= value / per <= high, where value and per are names of signals; without per the value itself is compared, and a missing bound is none."""

    name: str
    value: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("line_ends", "n_ellipses", "n_lines", None, 0.3),
    Rule("bullets", "n_bullets", "n_lines", None, 0.9),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.3),
    Rule("letters", "n_letter_words", "n_words", 0.7, None),
)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: a filter on the result, which Spark copies below a projection, cannot tear it apart."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def _covered(words: Column) -> Column:
    """How many words stand in a run of RUN words that the text has twice or more."""
    run = lambda i: [F.get(words, i + k) for k in range(RUN)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - RUN), lambda i: F.xxhash64(*run(i)).bitwiseAND(F.lit(-PLACE)).bitwiseOR(i.cast("long")))

    def maybe(h: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(h, k).bitwiseXOR(x).between(0, PLACE - 1), F.lit(False))
        return F.transform(F.filter(h, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x.bitwiseAND(F.lit(PLACE - 1)).cast("int"))

    def twice(r: Column) -> Column:
        same = lambda x, k: F.get(r, k)["run"].eqNullSafe(x["run"])
        return F.transform(F.filter(r, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    runs = F.transform(_let(F.sort_array(hashes), maybe), lambda i: F.struct(F.concat_ws(" ", *run(i)).alias("run"), i.alias("i")))
    places = F.transform(_let(F.sort_array(runs), twice), lambda i: F.transform(F.array(*map(F.lit, range(RUN))), lambda k: i + k))
    return F.when(F.size(words) >= RUN, F.size(F.array_distinct(F.flatten(places)))).otherwise(0)


def signals(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's rows as a struct _row, and the signals of the text as long columns."""

    def of_words(words: Column) -> dict[str, Column]:
        return {
            "n_words": F.size(words),
            "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))),
            "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
            "n_repeat_words": _covered(words),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_ellipses": F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*\\z"))),
            "n_bullets": F.size(F.filter(lines, lambda x: x.rlike("\\A[\\x20\\x09-\\x0D]*[-*•]"))),
        }

    def of_text(text: Column) -> dict[str, Column]:
        return {
            "word_chars": F.char_length(F.translate(text, SPACE, "")),
            "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        }

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = lambda found: F.struct(*(c.cast("long").alias(k) for k, c in found.items()))
    words = _let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: counted(of_words(w)))
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: counted(of_lines(x)))
    out = df.select(F.struct(*df.columns).alias("_row"), words.alias("_w"), lines.alias("_l"), counted(of_text(text)).alias("_t"), F.monotonically_increasing_id().alias("_n"))
    return out.select("_row", "_w.*", "_l.*", "_t.*", "_n")


def compiled(rules: tuple[Rule, ...]) -> list[tuple[str, Column, Column]]:
    """(name, what is compared, whether it is out of bounds) of each rule; a ratio to nothing is 0."""
    out = []
    for rule in rules:
        value = F.col(rule.value).cast("double")
        if rule.per:
            value = F.when(F.col(rule.per) > 0, value / F.col(rule.per)).otherwise(0.0)
        broken = F.lit(False)
        if rule.low is not None:
            broken |= value < F.lit(float(rule.low))
        if rule.high is not None:
            broken |= value > F.lit(float(rule.high))
        out.append((rule.name, value, broken))
    return out


def _judged(df: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    table = compiled(rules)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    broken = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(b, F.lit(name)) for name, _, b in table)))
    out = signals(df, text_col).select("*", base.alias("base_failed"), F.array_join(broken, ",").alias("broken_rules"))
    # _n is never negative; a filter on kept stays above the signals, which it would compute anew for each rule.
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == "") & (F.col("_n") >= 0)).drop("_n")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the signals, base_failed, broken_rules (names of the rules that a text breaks, in the table's order) and kept of every row."""
    out = _judged(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    return out.select("_row.doc_id", *(c for c in out.columns if c != "_row"))


def keep_rows(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, all columns as they are."""
    return _judged(docs, text_col, rules).filter("kept").select("_row.*")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of quality() over the table documents."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    symbols = "'[" + SYMBOLS.replace("|", r"\|") + "]'"
    ratio = lambda r: f"(CASE WHEN {r.per} > 0 THEN {r.value}::DOUBLE / {r.per} ELSE 0 END)" if r.per else f"{r.value}::DOUBLE"
    tests = ", ".join(
        "CASE WHEN " + " OR ".join([*([f"{ratio(r)} < {float(r.low)!r}::DOUBLE"] if r.low is not None else []), *([f"{ratio(r)} > {float(r.high)!r}::DOUBLE"] if r.high is not None else [])]) + f" THEN '{r.name}' END"
        for r in rules
    )
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT rid, doc_id, x, regexp_extract_all(x, '{WORD}') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM t),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY rid),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(x, {symbols}))::BIGINT AS n_symbols, len(list_filter(ws, lambda v: v IN ({stops})))::BIGINT AS n_stop_words,
  len(list_filter(ws, lambda v: regexp_matches(v, '\p{{L}}')))::BIGINT AS n_letter_words, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipses,
  len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullets, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {tests}) AS broken_rules FROM s)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM b"""
