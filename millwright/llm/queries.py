"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import (
    conversation_repair, decontaminate, html_text, license_scan, line_dedup, lm_score, packing, quality, sharding, simhash,
    token_alignment, token_count, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two bits or fewer."""
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the calibrated regression over every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs.select("doc_id", "text"), model).select("doc_id", "quality_rules.*")


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted interpolation over all documents."""
    return lm_score.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, token_count.vocabulary()).select("doc_id", "token_counts.*")


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; equal texts stay together."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "cosine", "overlap", "answer_overlap")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring line templates dropped from every document; the text as its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    left = line_dedup.drop_recurring_lines(docs)
    return left.select("doc_id", "dropped_lines", lines.alias("n_lines_left"), F.md5("text").alias("text_md5"))


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in token-budget batches of optimal length buckets."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumnRenamed("id", "doc_id")


ORACLES["op1_packing"] = packing.ORACLE


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and signature rules over every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    read = html_text.extract_main_text(pages.select("page_id", "url", "html"), html_text.train(pages), out="main_text")
    return read.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own rule, and blocks that reach it through redirects and canonical links."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "url_filter.*")


ORACLES["op11_url_filter"] = url_filter.ORACLE


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, what is wrong with them, and their cheapest repair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.audits(conversation_repair.repair(conversation_repair.damage(turns)))
    every = turns.select("conv_id").distinct()
    none = {c: F.lit(0).cast("long") for c in "gaps blank duplicate truncated illegal cost".split()}
    none |= {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left").select(
        "conv_id", *(F.coalesce(F.col(c), v).alias(c) for c, v in none.items())
    )


ORACLES["op13_conversation_repair"] = conversation_repair.ORACLE


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers over every document, and how usual their links are in all documents."""
    return token_alignment.link_statistics(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
