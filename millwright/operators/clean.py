"""Silver rules: deduplication, unit repair, incident and maintenance preparation, anonymisation."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import (
    celsius, combine_date_time, floor_hour, offset_to_utc, parse_time, standard_id, to_double, to_timestamp, to_whole,
)
from millwright.schemas import FAHRENHEIT_ABOVE, TYPE_COLUMNS


def dedup_rows(df: DataFrame) -> DataFrame:
    """Exact-row deduplication."""
    return df.dropDuplicates()


def dedup_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) in ``order``, which must be unique within a key.

    ``min_by`` combines on the map side, so a key copied into a third of all rows shuffles one row per
    task; a ``row_number`` window would sort all copies in one task. Null keys count as equal.
    """
    pick = F.min_by if keep == "first" else F.max_by
    rank = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(*[pick(F.col(c), rank).alias(c) for c in rest])
    return picked.select(*df.columns)


def dedup_mean(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Merge copies of a key by averaging the given columns."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def build_silver_telemetry(
    raw: DataFrame, order: str = "row_seq", fahrenheit_above: float = FAHRENHEIT_ABOVE, standardize: bool = True
) -> DataFrame:
    """Keep the first reading per machine and timestamp, repair units, drop rows without a timestamp.

    Rows without a timestamp are dropped before the grouping: they only ever form their own key.
    """
    machine = standard_id(F.col("machine_id")) if standardize else F.col("machine_id")
    rows = raw.withColumns({"machine_id_std": machine}).filter(F.col("timestamp").isNotNull())
    first = dedup_key(rows, ["machine_id_std", "timestamp"], [order])
    return first.withColumns(
        {
            "temperature_c": celsius(F.col("temperature_c"), fahrenheit_above),
            "window_start": floor_hour(F.col("timestamp")),
        }
    ).drop(order)


def anonymize_incident_operators(df: DataFrame, salt: str | None = None) -> DataFrame:
    """Replace operator name and badge by a key that holds for this run only.

    The key is a salted digest: equal badges share a key without a lookup table on the driver, and the
    random salt is never stored. Rows of a source without badges get a key each.
    """
    identity = [c for c in ("operator_name", "operator_badge") if c in df.columns]
    if "operator_key" in df.columns:
        return df.drop(*identity)
    salt = salt or secrets.token_hex(16)
    if "operator_badge" in df.columns:
        badge = F.col("operator_badge").cast("string")
        digest = F.sha2(F.concat(F.lit(salt), badge), 256)
        missing = F.raise_error(F.lit("an incident has no operator badge to anonymise")).cast("string")
        key = F.when(badge.isNull(), missing).otherwise(F.concat(F.lit("OP_"), digest))
    else:
        own = F.concat_ws("|", F.lit(salt), F.col("incident_id"), F.monotonically_increasing_id())
        key = F.concat(F.lit("OP_"), F.sha2(own, 256))
    return df.withColumn("operator_key", key.substr(1, 64)).drop(*identity)


def prepare_incidents(raw: DataFrame, salt: str | None = None) -> DataFrame:
    """Typed date, time, hour key, machine key, severity and type flags (unreadable numbers become 0)."""
    parsed = raw.withColumns(
        {"date": F.col("date").cast("string").try_cast("date"), "time": parse_time(F.col("time"))}
    )
    at = combine_date_time(F.col("date"), F.col("time"))
    keyed = parsed.withColumns(
        {
            "incident_at": at,
            "window_start": floor_hour(at),
            "machine_id_std": standard_id(F.col("machine_id")),
            **{
                c: F.coalesce(to_whole(F.col(c).cast("string")), F.lit(0))
                for c in ("severity", *TYPE_COLUMNS)
            },
        }
    )
    return anonymize_incident_operators(keyed, salt)


def prepare_maintenance(raw: DataFrame) -> DataFrame:
    """Naive UTC time, hour key and numeric duration."""
    at = F.col("maintenance_at")
    if dict(raw.dtypes)["maintenance_at"] == "string":
        at = offset_to_utc(at)
    elif dict(raw.dtypes)["maintenance_at"] == "timestamp":
        at = F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")
    return raw.withColumns(
        {
            "maintenance_at": at,
            "maintenance_hour": floor_hour(at),
            "duration_hours": to_double(F.col("duration_hours").cast("string")),
        }
    )


def coerce_telemetry(raw: DataFrame) -> DataFrame:
    """Text columns to their types; anything unreadable becomes null."""
    signals = [c for c in raw.columns if c in ("temperature_c", "pressure_bar", "voltage_mean_v", "rotation_mean_rpm")]
    return raw.withColumns(
        {
            "timestamp": to_timestamp(F.col("timestamp")),
            **{c: to_double(F.col(c)) for c in signals},
            "pieces_produced": to_whole(F.col("pieces_produced")),
        }
    )
