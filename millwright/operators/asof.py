"""Backward as-of join: the last event at or before each probe, per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.chunks import CHUNK
from millwright.functions.columns import epoch_hour


def last_event_before(probes: DataFrame, events: DataFrame, key: str, time: str, name: str, span_hours: int = 24) -> DataFrame:
    """Add ``name``, the time of the latest event not after the probe (null when there is none).

    Probes and events of a key are merged in time order inside spans of hours; the latest event of
    earlier spans is carried in, so a hot key is spread over its spans. Probes without a key or a time have no event;
    they skip the windows, where they would meet in one task.
    """
    unknown = F.col(key).isNull() | F.col(time).isNull()
    rest = probes.filter(unknown).withColumn(name, F.lit(None).cast("timestamp_ntz"))
    probes = probes.filter(~unknown)
    span = F.floor(epoch_hour(F.col(time)) / span_hours).alias(CHUNK)
    marks = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time).distinct()
    latest = marks.groupBy(key, span).agg(F.max(time).alias("__latest"))
    spans = probes.select(key, span).distinct()
    # One row per key and span; events' own spans are needed to hand their latest time on.
    known = latest.join(spans, [key, CHUNK], "full_outer")
    earlier = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select(key, CHUNK, F.max("__latest").over(earlier).alias("__carried"))

    left = probes.withColumns({"__event": F.lit(None).cast("timestamp_ntz"), "__probe": F.lit(True)})
    right = marks.select(key, time, F.col(time).alias("__event"))
    both = left.unionByName(right, allowMissingColumns=True).select("*", span)
    inside = Window.partitionBy(key, CHUNK).orderBy(F.col(time), F.col("__probe").asc_nulls_first())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    found = both.join(carried, [key, CHUNK], "left").withColumn(name, F.coalesce(F.max("__event").over(upto), F.col("__carried")))
    return found.filter("__probe").select(*probes.columns, name).unionByName(rest)


def hours_since_last_event_asof(probes: DataFrame, events: DataFrame, key: str, time: str) -> DataFrame:
    found = last_event_before(probes, events, key, time, "last_event_at")
    gap = F.col(time) - F.col("last_event_at")
    seconds = F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 + F.extract(F.lit("MINUTE"), gap) * 60
    return found.withColumn("hours_since", (seconds + F.extract(F.lit("SECOND"), gap)).cast("double") / 3600.0)
