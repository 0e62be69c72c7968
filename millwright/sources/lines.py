"""Lines of text files with their places, and records that run over several lines.

A file is split over tasks like any text file. What a line means may depend on all lines before it; that is put
together from one row per split, so no task sees more than its own lines and no file is read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

def before_line() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def earlier_blocks() -> WindowSpec:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their place: ``file``, ``block`` (byte offset of the split) and ``pos`` inside the block."""
    return spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the running total of ``value`` over all lines of the file before each line."""
    rows = lines.withColumn("__v", value)
    blocks = rows.groupBy("file", "block").agg(F.sum("__v").alias("__s")).select(
        "file", "block", F.coalesce(F.sum("__s").over(earlier_blocks()), F.lit(0)).alias("__base")
    )
    total = F.col("__base") + F.coalesce(F.sum("__v").over(before_line()), F.lit(0))
    return rows.join(blocks, ["file", "block"]).withColumn(name, total).drop("__v", "__base")


def with_open_quotes(lines: DataFrame, from_plain: Column, from_quote: Column) -> DataFrame:
    """Add ``__inside``: a quote is open before the line.

    ``from_plain`` and ``from_quote`` say whether one is open behind the line if none or one is open before it. So a
    line is one of four maps: leave the state, turn it, open or close it whatever it was. The state before a line is
    that of the last line that opens or closes, turned by the lines since; maps of splits are put together by a running
    count and one carried value, and no line is gathered.
    """
    rows = lines.withColumns({"__p": from_plain, "__q": from_quote})
    rows = carried(rows, (F.col("__p") & ~F.col("__q")).cast("int"), "__turns")
    fixed = F.when(F.col("__p") == F.col("__q"), F.struct("block", "pos", F.col("__p").alias("state"), F.col("__turns").alias("turns")))
    last = rows.groupBy("file", "block").agg(F.max(fixed).alias("__fixed"))
    held = last.select("file", "block", F.max("__fixed").over(earlier_blocks()).alias("__earlier"))
    rows = rows.withColumn("__fixed", F.max(fixed).over(before_line())).join(held, ["file", "block"])
    known = F.coalesce("__fixed", "__earlier")
    state = F.coalesce(known["state"].cast("int"), F.lit(0)) + F.col("__turns") - F.coalesce(known["turns"], F.lit(0))
    return rows.withColumn("__inside", state % 2 == 1).drop("__p", "__q", "__turns", "__fixed", "__earlier")


def joined(rows: DataFrame, starts: Column) -> DataFrame:
    """Each line for which ``starts`` holds, with the lines up to the next such line, at the place of the first."""
    at = F.when(starts, F.struct("block", "pos"))
    last = rows.groupBy("file", "block").agg(F.max(at).alias("__start"))
    open_start = last.select("file", "block", F.max("__start").over(earlier_blocks()).alias("__open"))
    to_line = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__start", F.max(at).over(to_line)).join(open_start, ["file", "block"])
    parts = placed.withColumn("__start", F.coalesce("__start", "__open")).groupBy("file", "__start").agg(
        F.sort_array(F.collect_list(F.struct("block", "pos", "line"))).alias("__lines")
    )
    text = F.array_join(F.col("__lines.line"), "\n")
    return parts.select(text.alias("line"), "file", F.col("__start.block").alias("block"), F.col("__start.pos").alias("pos"))
