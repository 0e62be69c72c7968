"""The training-data pipeline: documents to packed batches, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.storage import materialize, release, written_so_far
from millwright.llm import decontaminate, line_dedup, near_copies, packing, quality


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go. The regression learns from the labelled ones among ``docs``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.apply_rules(docs, model).where("quality_rules.kept").select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: recurring lines go, documents stay; ``n_chars`` follows the text."""
    left = line_dedup.drop_recurring_lines(docs)
    return left.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else left[c] for c in docs.columns))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of copies and near copies the first document stays."""
    return near_copies.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go, except for items too short to be evidence."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where(F.col("item_words") >= decontaminate.MIN_ITEM_WORDS).select(F.col("id").alias("__id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__id"]), "left_anti")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of what is left, in token-budget batches."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


#: (name, function): each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", keep_one_copy),
    ("decontamination", drop_leaks),
    ("packing", pack_batches),
]

#: The stages learn models and follow links over several rounds, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    Once a stage is written, what it was made from (the stage before, sketches, links, counts) is removed, so the folder
    holds the intermediates of one stage at a time. Runs of one session follow one another.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
