"""Column rules: typing, identifiers, hours and units. All are plain Catalyst expressions.

Hour arithmetic goes through ``epoch_hour``/``hour_to_ts`` rather than ``date_trunc``: both stay in
``timestamp_ntz``, so results do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.schemas import FAHRENHEIT_ABOVE


def epoch_hour(ts: Column) -> Column:
    """Whole hours since 1970-01-01, rounded down (also before 1970)."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    return (days * 24 + F.hour(ts)).cast("long")


def hour_to_ts(hour: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR") * hour


def floor_hour(ts: Column) -> Column:
    return hour_to_ts(epoch_hour(ts))


def standard_id(machine_id: Column) -> Column:
    return F.upper(F.trim(machine_id))


def finite(x: Column) -> Column:
    """NaN and infinities become null, the engine's only missing value."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_double(text: Column) -> Column:
    return finite(text.try_cast("double"))


def to_whole(text: Column) -> Column:
    """Lenient integer: '3', '3.0' and 3.0 give 3, anything unreadable gives null."""
    return to_double(text).try_cast("int")


def to_timestamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def parse_time(text: Column) -> Column:
    """'HH:mm' or 'HH:mm:ss' to a normalised 'HH:mm:ss' string, else null."""
    t = F.trim(text.cast("string"))
    short = F.when(t.rlike(r"^\d{1,2}:\d{1,2}$"), F.concat(t, F.lit(":00")))
    full = F.when(t.rlike(r"^\d{1,2}:\d{1,2}:\d{1,2}$"), t)
    stamp = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.coalesce(short, full)), F.lit("yyyy-MM-dd H:m:s"))
    return F.date_format(stamp, "HH:mm:ss")


def combine_date_time(date: Column, time: Column) -> Column:
    return F.concat(date.cast("date").cast("string"), F.lit(" "), time).try_cast("timestamp_ntz")


def offset_to_utc(text: Column) -> Column:
    """'2025-06-15 10:00:00+02' to a naive UTC timestamp; text without an offset is taken as UTC."""
    t = F.trim(text.cast("string"))
    body = F.regexp_extract(t, r"^(.*?)\s*(?:([+-])(\d{2}):?(\d{2})?|Z)?$", 1)
    sign = F.when(F.regexp_extract(t, r"([+-])(\d{2}):?(\d{2})?$", 1) == "-", -1).otherwise(1)
    has_offset = t.rlike(r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*[+-]\d{2}(:?\d{2})?$")
    hours = F.coalesce(F.regexp_extract(t, r"[+-](\d{2}):?(\d{2})?$", 1).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.regexp_extract(t, r"[+-](\d{2}):?(\d{2})?$", 2).try_cast("int"), F.lit(0))
    local = F.when(has_offset | t.endswith("Z"), body).otherwise(t).try_cast("timestamp_ntz")
    shift = F.when(has_offset, sign * (hours * 60 + minutes)).otherwise(0)
    return local - F.expr("INTERVAL '1' MINUTE") * shift


def celsius(temperature: Column, above: float = FAHRENHEIT_ABOVE) -> Column:
    """Readings above the threshold are taken as Fahrenheit, row by row."""
    return F.when(temperature > above, (temperature - 32.0) * 5.0 / 9.0).otherwise(temperature)


def utilization_pct(pieces: Column, capacity: Column) -> Column:
    return F.coalesce(finite(F.when(capacity > 0, 100.0 * pieces / capacity)), F.lit(0.0))


def safe_zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, and 0 wherever that is undefined."""
    return F.coalesce(finite((x - mean) / F.when(std != 0, std)), F.lit(0.0))


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""
