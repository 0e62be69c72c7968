"""Reading stored layers: parquet folders ``root/layer/table``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millwright.functions.columns import combine_date_time
from millwright.operators.contracts import ContractError
from millwright.operators.features import order_gold_columns
from millwright.schemas import LAYER_TABLES
from millwright.sinks.tables import gold_csv_path, gold_path, iso_text, list_runs, unpack_gold

PAGE_LIMIT = 500  # fixed value: largest preview page
#: Rows of a part of a table stored for paging, about, and the folder column that holds a row's part.
PART_ROWS = 100_000
PART = "page_part"
#: Where a row stands in the stored order.
PLACE = "page_place"


def layer_path(root: str, layer: str, table: str) -> str:
    if layer not in LAYER_TABLES:
        raise ContractError(f"unknown layer {layer!r}")
    return f"{root}/{layer}/{table}"


def list_datasets(spark: SparkSession) -> DataFrame:
    """The layer catalogue."""
    rows = [(layer, table) for layer, tables in LAYER_TABLES.items() for table in tables]
    return spark.createDataFrame(rows, "layer string, table string")


def read_layer(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    return spark.read.parquet(layer_path(root, layer, table))


def normalize_machine_column(df: DataFrame) -> DataFrame:
    """``machine_id`` from the standard id, else from the machine code, else as it is."""
    for source in ("machine_id_std", "machine_code"):
        if source in df.columns:
            return df.withColumn("machine_id", F.col(source))
    return df


def with_incident_time(incidents: DataFrame) -> DataFrame:
    if "incident_at" in incidents.columns:
        return incidents
    return incidents.withColumn("incident_at", combine_date_time(F.col("date"), F.col("time")))


def load_layer_frames(spark: SparkSession, root: str, layer: str) -> dict[str, DataFrame]:
    """The four frames a report needs, from bronze or silver."""
    if layer not in ("bronze", "silver"):
        raise ContractError(f"reports exist for bronze and silver, not {layer!r}")
    suffix = "_raw" if layer == "bronze" else ""
    return {
        "telemetry": normalize_machine_column(read_layer(spark, root, layer, f"telemetry{suffix}")),
        "incidents": with_incident_time(normalize_machine_column(read_layer(spark, root, layer, f"incidents{suffix}"))),
        "machines": read_layer(spark, root, layer, "machine"),
        "maintenance": normalize_machine_column(read_layer(spark, root, layer, "maintenance")),
    }


def load_gold(spark: SparkSession, root: str, table: str = "gold_dataset") -> DataFrame:
    """The wide gold table of the newest validated run, also when it was stored packed."""
    newest = list_runs(spark, root).filter((F.col("layer") == "gold") & F.col("run_dir").startswith(gold_path(root, table, "v"))).first()
    stored = spark.read.parquet(newest["run_dir"]) if newest else read_layer(spark, root, "gold", table)
    if {"features", "labels"} <= set(stored.columns):
        return unpack_gold(stored)
    return order_gold_columns(stored)


def page(df: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page in a stated order; the size is held between 1 and 500."""
    size = min(max(int(limit), 1), PAGE_LIMIT)
    return df.orderBy(*order).offset(max(int(offset), 0)).limit(size)


def write_pages(df: DataFrame, order: Sequence[str], path: str, part_rows: int = PART_ROWS) -> None:
    """Store a table so that any page of its order is found at once: sorted parts and an index of their running counts.

    Every range of the order is one task's, which cuts its sorted rows into parts of about ``part_rows``; as many ranges as the
    session has shuffle partitions, since Spark's driver gathers a sample for each. The index has one row for each part.
    """
    rows = df.count()
    parts = max(1, -(-rows // part_rows))
    ranges = max(1, min(parts // 4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size = -(-rows // (parts - ranges)) if ranges > 1 else part_rows  # the end of each range is one more part
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the range's number above, the row's number in its range in the lower 33 bits
    placed = ranged.withColumn(PLACE, F.monotonically_increasing_id())
    in_range = F.col(PLACE).bitwiseAND((1 << 33) - 1)
    part = F.shiftright(PLACE, 33) * (1 << 33) + F.floor(in_range / size)
    placed.withColumn(PART, part).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy(PART).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    counts.select(PART, "rows", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("start")).write.mode("overwrite").parquet(f"{path}/index")


def stored_page(spark: SparkSession, path: str, order: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a table stored by ``write_pages``: reads the parts that hold it, at any offset.

    Rows that are equal in the order keep the places they were stored at; the rest of the table is not opened.
    """
    size, offset = min(max(int(limit), 1), PAGE_LIMIT), max(int(offset), 0)
    at = spark.read.parquet(f"{path}/index").where((F.col("start") < offset + size) & (F.col("start") + F.col("rows") > offset)).collect()
    rows = spark.read.parquet(f"{path}/rows").where(F.col(PART).isin([r[PART] for r in at]))
    return rows.orderBy(PLACE).offset(offset - min((r["start"] for r in at), default=offset)).limit(size).drop(PART, PLACE)


def stored_tables(spark: SparkSession, root: str) -> DataFrame:
    """The layer catalogue with the rows of each stored table; null for one that is not there."""
    found = []
    for row in list_datasets(spark).collect():  # a fixed list
        try:
            n = read_layer(spark, root, row["layer"], row["table"]).count()
        except AnalysisException:
            n = None
        found.append((row["layer"], row["table"], n))
    return spark.createDataFrame(found, "layer string, table string, rows long")


def text_cells(df: DataFrame) -> DataFrame:
    """Dates and times as ISO text, as a preview shows them; everything else unchanged."""
    times = ("date", "timestamp_ntz", "timestamp")
    return df.select(*[iso_text(F.col(c)).alias(c) if t in times else F.col(c) for c, t in df.dtypes])


def preview(df: DataFrame, order: Sequence[str], limit: int = 100, offset: int = 0) -> tuple[DataFrame, int]:
    """A page with ISO texts and the total number of rows."""
    return text_cells(page(df, order, limit, offset)), df.count()


def list_gold_csvs(spark: SparkSession, root: str) -> DataFrame:
    """Gold exports with their run records, newest first."""
    return list_runs(spark, root).filter(F.col("layer") == "gold")


def preview_gold_csv(spark: SparkSession, root: str, run_name: str, limit: int = 100, offset: int = 0):
    rows = spark.read.options(header=True, escape='"').csv(gold_csv_path(root, run_name))
    return preview(rows, ["machine_id_std", "window_start"], limit, offset)
