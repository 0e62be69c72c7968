"""Feature families. Each family is a set of columns over a window; ``add_*`` runs one family on a
complete hourly grid, the gold plan runs them all over one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from millwright.functions.chunks import (
    CHUNK, CHUNK_HOURS, HOUR, block_lags, block_level, block_mean, block_std, leading_sum, over_chunks, rolling_blocks,
    running_total_columns, running_totals, trailing_sum, with_neighbours,
)
from millwright.functions.columns import epoch_hour, safe_zscore, utilization_pct
from millwright.functions.storage import materialize
from millwright.operators.hourly import KEYS, aggregate_incidents, aggregate_maintenance
from millwright.schemas import (
    GOLD_IDS, GOLD_LABELS, LABEL_HOURS, MEMORY_HOURS, PIECES, SIGNALS, TYPE_COLUMNS,
)

INCIDENT_FILLS = ["incident_count_1h", "incident_max_severity_1h", *TYPE_COLUMNS]
RUNNING = ["incident_count_1h", *TYPE_COLUMNS, "maintenance_count_1h"]


# ---- column families -------------------------------------------------------------------------

SIGNAL_BLOCKS = {f"{p}_mean_1h": "moments" for p in SIGNALS}
ALL_BLOCKS = {**SIGNAL_BLOCKS, PIECES: "sum", "incident_max_severity_1h": "max"}


def memory_columns(signals: Sequence[str] = SIGNALS) -> dict[str, Column]:
    """From the rolling blocks of the signals."""
    cols = {}
    for p in signals:
        x = f"{p}_mean_1h"
        for n in MEMORY_HOURS:
            cols[f"{p}_mean_{n}h"] = block_mean(x, n)
            cols[f"{p}_max_{n}h"] = F.col(f"__{x}_max{n}")
            cols[f"{p}_std_{n}h"] = F.coalesce(block_std(x, n), F.lit(0.0))
    return cols


def trend_columns(w: WindowSpec, signals: Sequence[str] = SIGNALS) -> dict[str, Column]:
    cols = {}
    for p in signals:
        x = F.col(f"{p}_mean_1h")
        for name, k in (("trend_6h", 6), ("delta_1h", 1), ("delta_3h", 3)):
            cols[f"{p}_{name}"] = F.coalesce(x - F.lag(x, k).over(w), F.lit(0.0))
    return cols


def rolling_zscore_columns(signals: Sequence[str] = SIGNALS) -> dict[str, Column]:
    cols = {}
    for p in signals:
        x = f"{p}_mean_1h"
        cols[f"{p}_zscore_24h"] = safe_zscore(F.col(x), block_mean(x, 24), block_std(x, 24))
    return cols


def machine_zscore_columns(signals: Sequence[str] = SIGNALS) -> dict[str, Column]:
    return {
        f"{p}_zscore_machine": safe_zscore(F.col(f"{p}_mean_1h"), F.col(f"{p}__train_mean"), F.col(f"{p}__train_std"))
        for p in signals
    }


def incident_history_columns(w: WindowSpec) -> dict[str, Column]:
    """From running totals; the severity maximum comes from its rolling block."""
    return {
        "incident_count_prev_24h": trailing_sum("incident_count_1h", 24, w),
        "incident_count_prev_7d": trailing_sum("incident_count_1h", 168, w),
        **{f"{c}_count_prev_24h": trailing_sum(c, 24, w) for c in TYPE_COLUMNS},
    }


def severity_column() -> dict[str, Column]:
    return {"incident_max_severity_prev_24h": F.col("__incident_max_severity_1h_max24")}


def maintenance_history_columns(w: WindowSpec) -> dict[str, Column]:
    return {"maintenance_count_prev_30d": trailing_sum("maintenance_count_1h", 720, w)}


def production_columns() -> dict[str, Column]:
    return {
        "pieces_produced_sum_24h": F.col(f"__{PIECES}_sum24"),
        "capacity_utilization_pct": utilization_pct(F.col(PIECES), F.col("max_hourly_capacity_pieces")),
    }


def label_columns(w: WindowSpec, include_current: bool = True, censored: bool = False) -> dict[str, Column]:
    """Incidents in the next h hours and the label "any". The current hour counts unless told otherwise.

    Near the end of a series the horizon is cut off; ``censored`` turns labels that are negative only
    because of that into null.
    """
    first = 0 if include_current else 1
    cols = {}
    for h in LABEL_HOURS:
        future = leading_sum("incident_count_1h", first, first + h - 1, w)
        label = future > 0
        if censored:
            reaches_end = F.lead(F.lit(1), first + h - 1).over(w).isNull()
            label = F.when(reaches_end & ~label, F.lit(None)).otherwise(label)
        cols[f"future_incident_count_{h}h"] = future
        cols[f"label_failure_next_{h}h"] = label
    return cols


def train_baseline(df: DataFrame, signals: Sequence[str] = SIGNALS) -> DataFrame:
    """Mean and sample deviation per machine, fitted on training rows, all signals in one aggregation."""
    train = df.filter(F.col("split_set") == "train")
    return train.groupBy("machine_id_std").agg(
        *[F.avg(f"{p}_mean_1h").alias(f"{p}__train_mean") for p in signals],
        *[F.stddev_samp(f"{p}_mean_1h").alias(f"{p}__train_std") for p in signals],
    )


# ---- one family at a time, on a complete hourly grid --------------------------------------------

def _over(df: DataFrame, build, names: Sequence[str], back: int = 0, ahead: int = 0, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Run a family and keep the input columns plus the named ones."""
    done = over_chunks(df, build, back=back, ahead=ahead, chunk_hours=chunk_hours)
    return done.select(*df.columns, *names)


def add_machine_reference(df: DataFrame, machines: DataFrame) -> DataFrame:
    """Left join of the machine attributes; machines without a reference row keep nulls.

    No broadcast hint: Spark broadcasts only while the reference is under its size threshold.
    """
    return df.join(machines.withColumnRenamed("machine_code", "machine_id_std"), "machine_id_std", "left")


def hours_since_last_event(df: DataFrame, count: str, name: str, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Hours since the last row with ``count > 0``: 0 in an event hour, null before the first event."""
    marked = df.withColumns({HOUR: epoch_hour(F.col("window_start")), "__event": F.when(F.col(count) > 0, True)})
    found = with_neighbours(marked, {"__event": ["__event"]}, ["__event"], chunk_hours=chunk_hours)
    since = (F.col(HOUR) - F.col("__event__prev")["h"]).cast("double")
    return found.withColumn(name, since).select(*df.columns, name)


def add_incident_context(df: DataFrame, incidents: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    joined = df.join(aggregate_incidents(incidents), KEYS, "left").fillna(0, INCIDENT_FILLS)
    joined = materialize(joined, "incident-hours")  # read by the carry over chunks and by the windows

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = running_totals(rows, ["incident_count_1h", *TYPE_COLUMNS], w).withColumns(incident_history_columns(w))
        return rolling_blocks(rows, {"incident_max_severity_1h": "max"}, w).withColumns(severity_column())

    names = [
        "incident_count_prev_24h", "incident_max_severity_prev_24h", "incident_count_prev_7d",
        *[f"{c}_count_prev_24h" for c in TYPE_COLUMNS],
    ]
    since = hours_since_last_event(joined, "incident_count_1h", "hours_since_last_incident", chunk_hours)
    since = since.fillna(-1.0, ["hours_since_last_incident"])
    return _over(since, build, names, back=167, chunk_hours=chunk_hours)


def add_maintenance_context(df: DataFrame, maintenance: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    joined = df.join(aggregate_maintenance(maintenance), KEYS, "left").fillna(0, ["maintenance_count_1h"])
    joined = materialize(joined, "maintenance-hours")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return running_totals(rows, ["maintenance_count_1h"], w).withColumns(maintenance_history_columns(w))

    since = hours_since_last_event(joined, "maintenance_count_1h", "__hours", chunk_hours)
    days = F.coalesce(F.col("__hours") / 24.0, F.lit(-1.0))
    since = since.withColumn("days_since_last_maintenance", days).drop("__hours")
    return _over(since, build, ["maintenance_count_prev_30d"], back=719, chunk_hours=chunk_hours)


def add_memory_features(df: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rolling_blocks(rows, SIGNAL_BLOCKS, w).withColumns(memory_columns())

    return _over(df, build, list(memory_columns()), back=23, chunk_hours=chunk_hours)


def add_trend_features(df: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    names = [f"{p}_{n}" for p in SIGNALS for n in ("trend_6h", "delta_1h", "delta_3h")]
    return _over(df, lambda d, w: d.withColumns(trend_columns(w)), names, back=6, chunk_hours=chunk_hours)


def add_anomaly_features(df: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    df = materialize(df, "imputed-hours")  # read by the fit and by the windows
    back, size, hour = 23, F.lit(chunk_hours), epoch_hour(F.col("window_start"))
    bounds = df.groupBy("machine_id_std").agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    chunks = bounds.select("machine_id_std", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") + back) / size))).alias(CHUNK))
    baseline = chunks.join(train_baseline(df), "machine_id_std", "left")

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.join(baseline, ["machine_id_std", CHUNK], "left")  # where the windows' shuffle has put the hours
        return rolling_blocks(rows, SIGNAL_BLOCKS, w).withColumns({**rolling_zscore_columns(), **machine_zscore_columns()})

    names = [f"{p}_{n}" for p in SIGNALS for n in ("zscore_24h", "zscore_machine")]
    return _over(df, build, names, back=back, chunk_hours=chunk_hours)


def add_production_features(df: DataFrame, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rolling_blocks(rows, {PIECES: "sum"}, w).withColumns(production_columns())

    return _over(df, build, list(production_columns()), back=23, chunk_hours=chunk_hours)


def add_future_labels(
    df: DataFrame, include_current: bool = True, censored: bool = False, chunk_hours: int = CHUNK_HOURS
) -> DataFrame:
    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return running_totals(rows, ["incident_count_1h"], w).withColumns(label_columns(w, include_current, censored))

    done = _over(df, build, GOLD_LABELS, ahead=max(LABEL_HOURS), chunk_hours=chunk_hours)
    return done.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL '1' HOUR"))


def order_gold_columns(gold: DataFrame) -> DataFrame:
    """Identifiers first, labels last, everything else between in its present order."""
    middle = [c for c in gold.columns if c not in GOLD_IDS + GOLD_LABELS]
    return gold.select(*GOLD_IDS, *middle, *GOLD_LABELS)


def all_window_columns(rows: DataFrame, w: WindowSpec, include_current: bool, censored: bool) -> DataFrame:
    """Every family over one window specification: one exchange, one sort, four window passes."""
    rows = rows.withColumns(
        {**running_total_columns(RUNNING, w), **block_lags(ALL_BLOCKS, 1, w), **trend_columns(w)}
    ).withColumns(block_level(ALL_BLOCKS, 1))
    rows = rows.withColumns(
        {
            **block_lags(ALL_BLOCKS, 3, w),
            **incident_history_columns(w),
            **maintenance_history_columns(w),
            **label_columns(w, include_current, censored),
        }
    ).withColumns(block_level(ALL_BLOCKS, 3))
    for size in (6, 12):
        rows = rows.withColumns(block_lags(ALL_BLOCKS, size, w)).withColumns(block_level(ALL_BLOCKS, size))
    return rows.withColumns(
        {
            **memory_columns(),
            **rolling_zscore_columns(),
            **machine_zscore_columns(),
            **production_columns(),
            **severity_column(),
        }
    )
