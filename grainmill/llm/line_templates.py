"""Line dedup by a log-template tree, in DataFrame operations.

Lines are the pieces between line feeds; words are the pieces between ASCII white space, A-Z lower-cased; a word with a digit is
variable from the start. The tree has fixed depth: a line's leaf is its number of words and its first LEADING words. A leaf holds as many
templates as its lines show. Words after the leading ones are counted by leaf and place, so that each has its support: the lines of the leaf that have it
at its place. A template keeps at least the share KEPT of these words, and LEAST of them: what a leaf's lines have by being there, their
leading words, says nothing. So the support that this many of a line's words reach is the size of the largest template that the line
can belong to; its words of at least the share SAME of that support are fixed, the others are variable, and the fixed words with
their places are the line's template. Lines of one template agree on them whatever other lines, templates or strays the leaf has, and
lines that share an opening only have none. A line is a template of its own, too.

A template that lies in MIN_DOCS documents or more is recurring, a line of LONG_WORDS words or more from LONG_DOCS documents on: its lines go, from all
documents. Lines of fewer than MIN_WORDS words stay, and a document's other lines keep their order and their line feeds.

Lines, templates and documents are named by MD5, 128 bits, so that no two are taken for one. Equal lines are one row, with a count, before supports are
made. A leaf's distinct lines are rows of BLOCK lines (and BLOCK_WORDS words) at most, in which words are counted by comparing lines. A leaf of one block needs no more; the
counts of others are laid out, a row a different word and block, summed over the leaf with partial sums before the shuffle, and meet their blocks by hash join, those of
the most frequent keys (at most HOT_GROUPS) by broadcast. So no leaf, word or template that grows with the table is dealt to one task. Bloom filters of bounded size keep lines in other leaves, and the texts of documents
that lose nothing, out of every shuffle.

Null text stays null and has no lines; empty text has none to drop. A very long text is one row, and its lines are rows like others. Ties do not arise: supports
are compared, never ranked. Rows repeated with one doc_id are told apart by their text: equal ones are one document and both lose
the same lines. A null doc_id is a document of its own text. An empty table gives no rows. Other columns are carried along, of whatever name;
only n_lines and n_dropped of the input give way to those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_groups, written
from .exact_dedup import key_filter, may_repeat

LEADING = 2
MIN_WORDS = 3
MIN_DOCS = 4
LONG_WORDS, LONG_DOCS = 50, 2
SAME = 0.5
KEPT, LEAST = 0.5, 2  # of the words after the leading ones
#: Distinct lines, and words of them, that are compared in one row.
BLOCK, BLOCK_WORDS = 64, 1 << 16
WHITE = r"\x20\x09-\x0D"


def masked(text: Column) -> Column:
    """text with "<*>" for each word that has a digit; a match starts at a word's start only, so this takes linear time."""
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9]*+[0-9])[^\x20\x09-\x0D]++", "<*>")).otherwise(text)


def words(line: Column) -> Column:
    return F.split(F.btrim(line, F.lit(" \t\x0b\x0c\r")), r"[\x20\x09-\x0D]+")


def tidy(text: Column) -> Column:
    """A line's words parted by single spaces; most lines are so already."""
    return F.when(text.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"), F.array_join(words(text), " ")).otherwise(text)


def _name(id_: Column, text: Column) -> Column:
    """A name of the document: its doc_id and its text."""
    return F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit("\n"), text))


def _recurs(docs: str, n: str) -> Column:
    return (F.col(docs) >= MIN_DOCS) | ((F.col(n) >= LONG_WORDS) & (F.col(docs) >= LONG_DOCS))


def _inside(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line, n, leaf, name, text of the lines whose leaf lies in enough documents; the text is masked, its words parted by single spaces."""
    texts = df.select(_name(F.col(id_col), F.col(text_col)).alias("doc"), F.col(text_col).alias("_text")).filter("_text is not null")
    # Each line is counted and its first words are cut out once. A filter on the leaf or the count would be pushed down and do it again.
    n = F.regexp_count("text", F.lit(f"[^{WHITE}]+"))
    lead = F.regexp_extract("text", f"^[{WHITE}]*+((?:[^{WHITE}]++[{WHITE}]*+){{0,{LEADING}}})", 1)
    lines = texts.select("doc", F.posexplode(F.split("_text", "\n")).alias("line", "text"))
    lines = lines.select("doc", "line", "text", n.alias("n"), F.xxhash64(n, words(masked(ascii_lower(lead)))).alias("leaf"))
    by_doc = lines.select(F.xxhash64("doc").alias("h"), "leaf", "n").groupBy("leaf", "h").agg(F.max("n").alias("n"))
    leaves = written(by_doc.groupBy("leaf").agg(F.count("*").alias("docs"), F.max("n").alias("n")).filter(_recurs("docs", "n") & (F.col("n") >= MIN_WORDS)).select("leaf"))
    flagged = may_repeat(lines, F.col("leaf"), *key_filter(leaves.select(F.col("leaf").alias("h")), leaves.count())).filter("_may").select("_row.*")
    text = tidy(masked(ascii_lower(F.col("text"))))
    out = flagged.filter(F.col("n") >= MIN_WORDS).select("doc", "line", "n", "leaf", text.alias("text"))
    return written(out.withColumn("name", F.md5("text")))


def _general(inside: DataFrame) -> DataFrame:
    """name, lines, template of the lines that have one."""
    rows = written(inside.groupBy("leaf", "name").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.count("*").alias("lines")))
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")  # a line that is alone in its leaf is its own template
    met = join_groups(rows, sizes, "leaf", "size", max(1, rows.count()), "name").filter("size is not null")
    # A leaf of few lines is one block; others have as many as keep blocks small.
    each = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_WORDS) / F.col("n"))))
    blocks = F.ceil(F.col("size") / each)
    line = F.struct("name", "n", "lines", F.split("text", " ").alias("words"))
    dealt = met.withColumn("whole", blocks <= 1).withColumn("block", F.pmod(F.xxhash64("name"), blocks).cast("int"))
    held = written(dealt.groupBy("leaf", "block", "whole").agg(F.collect_list(line).alias("ls")))
    one = "aggregate(ls, 0L, (s, o) -> s + if(o.words[p] = w, o.lines, 0L))"
    alone = held.filter("whole").select("leaf", F.explode(F.expr(_lines(one))).alias("me"))
    parts = held.filter("not whole")
    known = f"filter(known[p - {LEADING}], x -> x.word = w)[0].support"
    apart = parts.join(_known(parts, one), ["leaf", "block"]).select("leaf", F.explode(F.expr(_lines(known))).alias("me"))
    own = alone.unionByName(apart).select("leaf", "me.*")
    least = F.greatest(F.lit(LEAST), F.ceil((F.col("n") - LEADING) * F.lit(KEPT)).cast("int"))
    own = own.withColumn("reach", F.get(F.sort_array("have", asc=False), least - 1)).filter("reach > 1")
    # As an argument of the lambda, reach is found once a line and not once a word.
    shape = F.expr(f"transform(array(reach), r -> array_join(transform(words, (w, p) -> if(p < {LEADING} or have[p] > 1 and have[p] >= {SAME} * r, w, '<*>')), ' '))[0]")
    return own.select("name", "lines", F.md5(F.concat_ws(" ", F.col("leaf").cast("string"), shape)).alias("template"))


def _lines(support: str) -> str:
    """SQL: a block's lines, each with the support of its words; that of a word w at a place p is the expression given."""
    return f"transform(ls, me -> struct(me.name, me.n, me.lines, me.words, transform(me.words, (w, p) -> if(p < {LEADING} or w = '<*>', 0L, {support})) as have))"


def _known(parts: DataFrame, one: str) -> DataFrame:
    """leaf, block, known: by place the words of a block with their support in the whole leaf.

    Words are counted inside blocks first, so that a row is laid out a different word and block; sums over a leaf's blocks meet the blocks again."""
    places = f"transform(sequence({LEADING}, size(ls[0].words) - 1), p -> transform(array_distinct(transform(ls, o -> o.words[p])), w -> struct(p as at, w as word, {one} as lines)))"
    laid = written(parts.select("leaf", "block", F.explode(F.expr(f"flatten({places})")).alias("x")).select("leaf", "block", "x.*", F.xxhash64("leaf", "x.at", "x.word").alias("spot")))
    support = laid.groupBy("spot").agg(F.sum("lines").alias("support"), F.count("*").alias("size"))
    met = join_groups(laid.select("leaf", "block", "at", "word", "spot"), support, "spot", "size", max(1, laid.count()), "block")
    by = met.groupBy("leaf", "block", "at").agg(F.collect_list(F.struct("word", "support")).alias("ws"))
    return by.groupBy("leaf", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "ws"))), lambda k: k["ws"]).alias("known"))


def templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc, line, template of the lines in the leaves that many documents share, and template, lines, docs of the recurring ones)."""
    inside = _inside(df, id_col, text_col)
    slim = inside.select("doc", "line", "n", "name")
    met = join_groups(slim, _general(inside), "name", "lines", max(1, inside.count()), "doc").filter("template is not null").select("doc", "line", F.lit(0).alias("n"), F.concat(F.lit("t"), "template").alias("template"))
    found = written(slim.select("doc", "line", "n", F.concat(F.lit("l"), "name").alias("template")).unionByName(met))
    by_doc = found.groupBy("template", "doc").agg(F.count("*").alias("lines"), F.max("n").alias("n"))
    return found, by_doc.groupBy("template").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("n").alias("n")).filter(_recurs("docs", "n")).select("template", "docs", "lines")


def drop_recurring(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the recurring lines taken out of the text, and n_lines, n_dropped."""
    found, recurring = templates(df, id_col, text_col)
    hit = join_groups(found.select("doc", "line", "template"), recurring, "template", "lines", max(1, found.count()), "doc").filter("docs is not null")
    gone = written(hit.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    name = _name(F.col(id_col), F.col(text_col))
    flagged = may_repeat(df, F.xxhash64(name), *key_filter(gone.select(F.xxhash64("doc").alias("h")), gone.count()))
    text = F.col(f"_row.`{text_col}`")
    lines = F.split(text, "\n")

    def row(left: Column, dropped: Column) -> list[Column]:
        n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
        return [left.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in df.columns if c not in ("n_lines", "n_dropped")] + [n_lines.alias("n_lines"), dropped.alias("n_dropped")]

    alone = flagged.filter("not _may").select(*row(text, F.lit(0)))
    met = flagged.filter("_may").withColumn("_name", _name(F.col(f"_row.`{id_col}`"), text)).join(gone.hint("merge"), F.col("_name") == F.col("doc"), "left")  # the same plan at every size
    left = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda x, k: ~F.array_contains("gone", k)), "\n"))
    return alone.unionByName(met.select(*row(left, F.coalesce(F.size("gone"), F.lit(0)))))
