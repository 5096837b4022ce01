"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, importance, jaccard, language_id, line_templates, media, mixing, packing, pii, prefix_trie, quality_rules, secrets, sharding
from .common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file; each executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op3_evidence_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four kinds of evidence, with trigram models of the labelled documents, and the documents themselves."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    model = language_id.fit(language_id.sample(docs, "doc_id", "text", "lang"))
    by_page = language_id.identify(pages, model, "page_id", **language_id.page_evidence())
    by_doc = language_id.identify(docs, model, "doc_id", F.col("text"), F.col("lang"), F.col("source"))
    return by_doc.withColumn("kind", F.lit("document")).withColumnRenamed("id", "doc_id").unionByName(by_page.withColumn("kind", F.lit("page")).withColumnRenamed("id", "page_id"), allowMissingColumns=True)


def op4_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_netpbm_bmp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_images(read(spark, sf_dir, "documents"))


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op8_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(read(spark, sf_dir, "documents"), shards=40)


def op9_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_histogram_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(read(spark, sf_dir, "conversations")))


_ALL = (
    op1_partenum_jaccard, op2_guess_cost_secrets, op3_evidence_language_id, op4_template_line_dedup, op5_cost_packing, op6_netpbm_bmp_tiles,
    op7_skip_chain_pii, op8_ring_sharding, op9_bloom_dedup, op10_histogram_mixing, op11_quality_rules, op12_importance_resampling,
    op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

SQL: dict[str, str] = {
    "op9_bloom_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)""",
    "op10_histogram_mixing": "SELECT doc_id, size, source_size, round(target, 6) AS target, taken FROM (" + mixing.SQL + ")",
    "op11_quality_rules": quality_rules.sql(),
    "op12_importance_resampling": importance.sql(),
    "op13_prefix_trie": prefix_trie.SQL,
}
