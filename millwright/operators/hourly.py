"""Raw events to one row per machine and hour: aggregation, complete grid, chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.chunks import CHUNK_HOURS, HOUR, with_neighbours
from millwright.functions.columns import epoch_hour, hour_to_ts
from millwright.functions.storage import attach_row, materialize
from millwright.schemas import PIECES, PREFIX_OF_SIGNAL, SPLIT_NAMES, SPLIT_PROBS, TYPE_COLUMNS

KEYS = ["machine_id_std", "window_start"]


def aggregate_hourly(telemetry: DataFrame) -> DataFrame:
    """Mean and max of each signal and the piece total; an observed hour without piece counts gives 0."""
    stats = []
    for prefix, column in PREFIX_OF_SIGNAL.items():
        stats += [F.avg(column).alias(f"{prefix}_mean_1h"), F.max(column).alias(f"{prefix}_max_1h")]
    pieces = F.coalesce(F.sum(F.col("pieces_produced").cast("double")), F.lit(0.0)).alias(PIECES)
    keyed = telemetry.filter(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull())
    return keyed.groupBy(*KEYS).agg(*stats, pieces)


def aggregate_incidents(incidents: DataFrame) -> DataFrame:
    keyed = incidents.filter(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull())
    return keyed.groupBy(*KEYS).agg(
        F.count("incident_id").alias("incident_count_1h"),
        F.max("severity").alias("incident_max_severity_1h"),
        *[F.sum(c).alias(c) for c in TYPE_COLUMNS],
    )


def aggregate_maintenance(maintenance: DataFrame) -> DataFrame:
    keyed = maintenance.select(
        F.col("machine_code").alias(KEYS[0]), F.col("maintenance_hour").alias(KEYS[1]), "maintenance_id"
    ).filter(F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull())
    return keyed.groupBy(*KEYS).agg(F.count("maintenance_id").alias("maintenance_count_1h"))


def machine_bounds(hourly: DataFrame) -> DataFrame:
    """First and last observed hour per machine."""
    return hourly.groupBy(KEYS[0]).agg(
        F.min("window_start").alias("first_hour"), F.max("window_start").alias("last_hour")
    )


def hourly_grid(bounds: DataFrame, days_per_piece: int = 360) -> DataFrame:
    """Every hour between the bounds of each machine.

    Exploded in two steps with a redistribution between them, so that one long-lived machine is spread
    over many tasks. Their number is explicit, as adaptive execution would merge the few bytes of the pieces.
    """
    size = 24 * days_per_piece
    low, high = epoch_hour(F.col("first_hour")), epoch_hour(F.col("last_hour"))
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = bounds.select(
        KEYS[0], low.alias("lo"), high.alias("hi"),
        F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("piece"),
    ).repartition(tasks, F.col(KEYS[0]), F.col("piece"))
    start, stop = F.greatest("lo", F.col("piece") * size), F.least("hi", (F.col("piece") + 1) * size - 1)
    hours = pieces.select(KEYS[0], F.explode(F.sequence(start, stop)).alias("hour"))
    return hours.select(KEYS[0], hour_to_ts(F.col("hour")).alias("window_start"))


def complete_hourly_grid(hourly: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Every hour between the first and last one of each machine, with nulls where nothing was observed.

    Each observed hour is spread over the gap behind it, inside its (machine, chunk) group, so only observed hours are
    shuffled and sorted. Rows without a machine or an hour have no place in the grid.
    """
    marked = hourly.filter(F.col(KEYS[1]).isNotNull()).withColumns({HOUR: epoch_hour(F.col(KEYS[1])), "__cell": F.lit(True)})
    near = with_neighbours(marked, {"__cell": ["__cell"]}, chunk_hours=chunk_hours)
    # copies of an hour are each kept, and only one of them has the gap behind it
    last = F.coalesce(F.greatest(F.col(HOUR), F.col("__cell__next")["h"] - 1), F.col(HOUR))
    spread = near.withColumn("__at", F.explode(F.sequence(F.col(HOUR), last)))
    here = F.col("__at") == F.col(HOUR)
    values = [F.when(here, F.col(c)).alias(c) for c in hourly.columns if c not in KEYS]
    return spread.select(KEYS[0], hour_to_ts(F.col("__at")).alias(KEYS[1]), *values)


def split_thresholds(rows_per_hour: DataFrame, probs: Sequence[float] = SPLIT_PROBS) -> DataFrame:
    """One row ``q0..`` of exact hour quantiles from (hour, n); the input has one row per calendar hour."""
    found = rows_per_hour.agg(F.percentile(F.col("hour"), F.array(*map(F.lit, probs)), F.col("n")).alias("q"))
    return found.select(*[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])


def grid_rows_per_hour(bounds: DataFrame) -> DataFrame:
    """How many machines cover each hour, without building the grid.

    A machine adds one at its first hour and takes it away after its last; the running total over the
    calendar gives the count. The only unpartitioned window sees at most one row per calendar hour.
    """
    low, high = epoch_hour(F.col("first_hour")), epoch_hour(F.col("last_hour"))
    steps = bounds.select(
        F.explode(F.array(F.struct(low.alias("hour"), F.lit(1).alias("d")), F.struct((high + 1).alias("hour"), F.lit(-1).alias("d")))).alias("s")
    ).groupBy(F.col("s.hour").alias("hour")).agg(F.sum("s.d").alias("d"))
    calendar = Window.orderBy("hour")
    levels = steps.select(
        "hour",
        F.sum("d").over(calendar.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        F.lead("hour").over(calendar).alias("until"),
    ).filter(F.col("n") > 0)
    return levels.select(F.explode(F.sequence("hour", F.col("until") - 1)).alias("hour"), "n")


def split_of(hour: Column, names: Sequence[str] = SPLIT_NAMES) -> Column:
    """Chronological split by strict comparison with the quantile hours ``q0`` and ``q1``."""
    return F.when(hour < F.col("q0"), names[0]).when(hour < F.col("q1"), names[1]).otherwise(names[2])


def label_split(df: DataFrame, thresholds: DataFrame, names: Sequence[str] = SPLIT_NAMES) -> DataFrame:
    split = split_of(epoch_hour(F.col("window_start")), names)
    return attach_row(df, thresholds).withColumn("split_set", split).drop("q0", "q1")


def add_temporal_split(grid: DataFrame, probs: Sequence[float] = SPLIT_PROBS) -> DataFrame:
    per_hour = grid.groupBy(epoch_hour(F.col("window_start")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return label_split(grid, split_thresholds(per_hour, probs))


def split_hourly_grid(hourly: DataFrame) -> DataFrame:
    """The complete grid with its split labels.

    The hourly rows are written once, the thresholds come from each machine's first and last hour: neither the raw
    rows nor the grid are read to learn them.
    """
    hourly = materialize(hourly, "hourly")
    bounds = machine_bounds(hourly)
    return label_split(complete_hourly_grid(hourly), split_thresholds(grid_rows_per_hour(bounds)))
