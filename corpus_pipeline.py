"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns a DataFrame that run() writes as Parquet to the
shared folder and reads again, after which the stage's own tables are removed. All but the last return the columns of documents; further columns, of
whatever name, are carried along.

What every stage does with odd rows: null and empty texts are rows like others unless a stage says so; texts of any length are read whole; repeated
rows and ties have the result named below whatever the order of rows; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import exact_dedup, jaccard, language_id, mixing, packing
from grainmill.llm.common import freed, mark, read
from grainmill.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: those without letters (null and empty texts too), and those surely in another language than declared.

    Rows that share a doc_id go together; rows with a null lang or source lack that evidence only."""
    return language_id.accepted_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that of the largest doc_id; null counts as an empty text, and a null doc_id stays only where no row has one."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of the Jaccard join; texts without words and rows without doc_id have no links and stay."""
    return jaccard.keep_rows(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; a null source is a source, and rows equal in doc_id and text are taken together."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; each row, repeated or not, is packed on its own, and an empty text is its end token."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mixed), ("packing", packed)]

#: Trigram models and tokenizers are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), len(STAGES) - 1
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        docs = stage(spark, docs, sf_dir)
        if k < last:
            docs = freed(docs, since)
    return docs
