"""Keyed tables in buckets: an upsert reads and rewrites only the buckets that its keys fall into."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.storage import materialize
from millwright.operators.clean import dedup_key

#: Name of the folder column that holds a row's bucket.
BUCKET = "key_bucket"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a key; a null is a key like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """The whole table, a folder for each bucket. Choose ``buckets`` so that a bucket is some hundred megabytes."""
    rows = df.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET)
    rows.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def upsert_keyed(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], buckets: int, order: str | None = None) -> list[int]:
    """Put the incoming rows in the place of those with their keys; returns the buckets that were rewritten.

    Among incoming copies of a key the last in ``order`` wins. Folders of other buckets are neither listed for reading
    nor written: the touched numbers (at most ``buckets``) prune the scan, and only their folders are replaced. Old rows
    are dropped by an anti-join against the incoming keys; none of them is sorted or grouped. ``buckets`` must be that of
    ``write_keyed``. Columns that the table lacks raise; those that the incoming rows lack become null.
    """
    stored = spark.read.parquet(path)
    extra = set(incoming.columns) - set(stored.columns) - {order}
    if extra:
        raise ValueError(f"the stored table lacks columns: {sorted(extra)}")
    new = dedup_key(incoming, list(keys), [order] if order else list(keys), keep="last").drop(*([order] if order and order not in stored.columns else []))
    new = materialize(new.withColumn(BUCKET, bucket_of(keys, buckets)), "upsert")
    touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    old = stored.where(F.col(BUCKET).isin(touched)).alias("old")
    names = new.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(BUCKET).alias("__bucket"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(BUCKET) == F.col("__bucket")]
    kept = old.join(names, same, "left_anti").select(*stored.columns)
    merged = materialize(kept.unionByName(new, allowMissingColumns=True), "upsert")  # written before its sources go
    merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched
