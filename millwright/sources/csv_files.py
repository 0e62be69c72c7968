"""CSV sources. Columns are read as text and typed leniently, so one bad cell never fails a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millwright.operators.clean import coerce_telemetry, prepare_incidents
from millwright.operators.contracts import require_columns
from millwright.schemas import INCIDENT_REQUIRED, TELEMETRY_REQUIRED
from millwright.sources.lines import joined, placed_lines, with_open_quotes

_CORRUPT = "__corrupt_record"


# Fixed patterns of CSV text: a quote opens a value at its start only, and is doubled inside.
QUOTED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
OPENS = r'(^|,)"'
TO_CLOSE = r'^[^"]*+(?:""[^"]*+)*+"'


def _whole_records(rows: DataFrame, first: str) -> DataFrame:
    """``rows`` without the corrupt-record column; raises for one whose number of fields is wrong."""
    # the message names a data column too: Spark reads no file for the corrupt record alone
    shown = F.concat(F.lit("a CSV record has the wrong number of fields: "), F.coalesce(_CORRUPT, F.col(f"`{first}`"), F.lit("")))
    whole = F.when(F.col(_CORRUPT).isNull(), True).otherwise(F.raise_error(shown).cast("boolean"))
    return rows.filter(whole).drop(_CORRUPT)


def _columns(spark: SparkSession, path: str | list[str]) -> StructType:
    return spark.read.options(header=True, escape='"').csv(path).schema


def read_text_csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """All columns as text plus ``row_seq``, the position of the row in its source.

    A quote inside quoted text is doubled; ``multiline`` allows line breaks there. A record with too few or too many
    fields raises instead of shifting its values. ``row_seq`` orders by file, block and row within the block, which
    holds whatever way Spark groups blocks into tasks.
    """
    if multiline:
        return read_multiline_csv(spark, path)
    columns = _columns(spark, path)
    rows = spark.read.options(header=True, mode="PERMISSIVE", escape='"', columnPruning=False, columnNameOfCorruptRecord=_CORRUPT)
    rows = rows.schema(StructType([*columns.fields, StructField(_CORRUPT, StringType())])).csv(path)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _whole_records(rows.select("*", position.alias("row_seq")), columns[0].name)


def read_multiline_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_text_csv``, with line breaks inside quoted text; files are split over tasks all the same.

    Lines are joined while a quote is open before them. Every file starts with a header, which is one line. Line breaks
    inside text come back as ``\\n``; blank lines between records are no records.
    """
    columns = _columns(spark, path)
    lines, line = placed_lines(spark, path), F.col("line")

    def opened(text: Column) -> Column:
        return F.regexp_replace(text, QUOTED, "$1").rlike(OPENS)

    behind = F.regexp_replace(line, TO_CLOSE, "x")  # what follows a closing quote is no start of a value
    rows = with_open_quotes(lines, opened(line), ~line.rlike(TO_CLOSE) | opened(behind))
    records = joined(rows, ~F.col("__inside")).where(F.trim("line") != "")
    header = records.where("block = 0").groupBy("file").agg(F.min("pos").alias("__header"))
    records = records.join(header, "file").where((F.col("block") > 0) | (F.col("pos") > F.col("__header")))
    schema = StructType([*columns.fields, StructField(_CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": _CORRUPT}
    cells = F.from_csv("line", F.lit(schema.toDDL()), options).alias("c")
    position = F.struct("file", "block", F.col("pos").alias("row")).alias("row_seq")
    return _whole_records(records.select(cells, position).select("c.*", "row_seq"), columns[0].name)


def load_telemetry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    raw = require_columns(read_text_csv(spark, path), TELEMETRY_REQUIRED, "telemetry")
    return coerce_telemetry(raw)


def load_incidents(spark: SparkSession, path: str | list[str], salt: str | None = None) -> DataFrame:
    # operators type the comments, so they may hold line breaks
    raw = require_columns(read_text_csv(spark, path, multiline=True), INCIDENT_REQUIRED, "incidents")
    return prepare_incidents(raw, salt).drop("row_seq")


def source_summary(df: DataFrame, time: str, machine: str = "machine_id") -> DataFrame:
    """Rows, machines and unreadable timestamps of a loaded source."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(machine).alias("machines"),
        F.count(F.when(F.col(time).isNull(), 1)).alias("invalid_timestamps"),
    )
