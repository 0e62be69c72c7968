"""Quality and exploration tables: the numbers behind each report chart, one DataFrame each."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.columns import floor_hour, is_blank
from millwright.functions.quantiles import exact_quantiles, row_salt, with_group_row
from millwright.functions.storage import attach_row
from millwright.schemas import RAW_SIGNALS, TYPE_COLUMNS


def incidents_per_day(incidents: DataFrame) -> DataFrame:
    """Counts per calendar day, zero between the first and the last day without incidents."""
    counts = (
        incidents.filter(F.col("incident_at").isNotNull())
        .groupBy(F.col("incident_at").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).alias("incidents"))
    )
    span = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter(F.col("a").isNotNull())
    days = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.join(counts, "day", "left").fillna(0, ["incidents"])


def weekday_hour_matrix(incidents: DataFrame) -> DataFrame:
    rows = incidents.filter(F.col("incident_at").isNotNull() & F.col("incident_id").isNotNull()).select(
        F.date_format("incident_at", "EEEE").alias("weekday"), F.hour("incident_at").alias("hour")
    )
    matrix = rows.groupBy("weekday").pivot("hour", list(range(24))).count().fillna(0)
    return matrix.select("weekday", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Rows per value, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))


def top_machines(incidents: DataFrame, n: int = 15) -> DataFrame:
    """Machines with most incidents and their mean severity; ties by machine."""
    counts = incidents.filter(F.col("machine_id").isNotNull()).groupBy("machine_id").agg(
        F.count("severity").alias("count"), F.avg("severity").alias("mean")
    )
    return counts.orderBy(F.desc("count"), "machine_id").limit(n)


def severity_by_type(incidents: DataFrame) -> DataFrame:
    flags = [c for c in TYPE_COLUMNS if c in incidents.columns]
    return incidents.filter(F.col("severity").isNotNull()).groupBy("severity").agg(*[F.sum(c).alias(c) for c in flags])


def comment_presence(incidents: DataFrame) -> DataFrame:
    status = F.when(is_blank(F.col("comment")), "empty").otherwise("comment")
    return incidents.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def frequent_comments(incidents: DataFrame, n: int = 20) -> DataFrame:
    rows = incidents.filter(~is_blank(F.col("comment"))).groupBy(F.trim("comment").alias("comment"))
    return rows.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comment").limit(n)


def box_summary(telemetry: DataFrame, signals: Sequence[str] = RAW_SIGNALS, by: str = "machine_id") -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (the furthest points inside the fences) and outlier count per machine and signal.

    Whiskers and counts are taken in salted partials and merged, so a machine with much of the data is many tasks.
    """
    signals = list(signals)
    numbers = [F.col(s).cast("double").alias(s) for s in signals]
    rows = telemetry.select(by, *numbers, row_salt(telemetry, signals).alias("__salt")).filter(F.col(by).isNotNull())
    quartiles = exact_quantiles(telemetry, signals, [0.25, 0.5, 0.75], [by])
    joined = with_group_row(rows, quartiles, [by])
    partial, merged, cells = [], [], []
    for s in signals:
        x, q1, q3 = F.col(s), F.col(f"{s}_q0"), F.col(f"{s}_q2")
        inside = (x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))
        partial += [
            F.min(F.when(inside, x)).alias(f"{s}__low"), F.max(F.when(inside, x)).alias(f"{s}__high"), F.count(F.when(~inside, 1)).alias(f"{s}__out"),
            *[F.first(f"{s}_q{i}").alias(f"{s}__q{i}") for i in range(3)],
        ]
        merged += [
            F.min(f"{s}__low").alias(f"{s}__low"), F.max(f"{s}__high").alias(f"{s}__high"), F.sum(f"{s}__out").alias(f"{s}__out"),
            *[F.first(f"{s}__q{i}").alias(f"{s}__q{i}") for i in range(3)],
        ]
        names = {"q0": "q1", "q1": "median", "q2": "q3", "low": "whisker_low", "high": "whisker_high", "out": "outliers"}
        cells.append(F.struct(F.lit(s).alias("signal"), *[F.col(f"{s}__{k}").alias(v) for k, v in names.items()]))
    wide = joined.groupBy(by, "__salt").agg(*partial).groupBy(by).agg(*merged)
    return wide.select(by, F.explode(F.array(*cells)).alias("b")).select(by, "b.*").filter(F.col("median").isNotNull())


def correlations(df: DataFrame, columns: Sequence[str], complete_rows: bool = True) -> DataFrame:
    """Pearson correlation per column pair, one aggregation for all pairs.

    ``complete_rows`` keeps rows without any null; otherwise each pair uses its own complete rows.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.na.drop() if complete_rows else rows
    pairs = list(combinations(columns, 2))
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs]
    return wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def with_incident_counts(telemetry: DataFrame, incidents: DataFrame) -> DataFrame:
    """Telemetry left-joined on the exact timestamp with hourly incident counts; others get 0."""
    hourly = incidents.groupBy("machine_id", floor_hour(F.col("incident_at")).alias("timestamp")).agg(
        F.count(F.lit(1)).alias("incidents")
    )
    return telemetry.join(hourly, ["machine_id", "timestamp"], "left").fillna(0, ["incidents"])


def signal_incident_correlations(telemetry: DataFrame, incidents: DataFrame, signals: Sequence[str] = RAW_SIGNALS) -> DataFrame:
    return correlations(with_incident_counts(telemetry, incidents), [*signals, "incidents"], complete_rows=False)


def machine_volumes(incidents: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Incidents and maintenances per machine (outer join of the two counts)."""
    left = value_counts(incidents, "machine_id", "incidents")
    right = value_counts(maintenance, "machine_id", "maintenances")
    return left.join(right, "machine_id", "full_outer").fillna(0, ["incidents", "maintenances"])


def machine_volumes_long(incidents: DataFrame, maintenance: DataFrame) -> DataFrame:
    wide = machine_volumes(incidents, maintenance)
    return wide.unpivot(["machine_id"], ["incidents", "maintenances"], "indicator", "n")


def machine_component_matrix(maintenance: DataFrame, components: Sequence[str] | None = None) -> DataFrame:
    """Maintenances per machine and component; without ``components`` Spark looks them up first."""
    rows = maintenance.filter(F.col("machine_id").isNotNull() & F.col("maintenance_id").isNotNull())
    return rows.groupBy("machine_id").pivot("component", list(components) if components else None).count().fillna(0)


def missing_share(df: DataFrame, n: int | None = 20) -> DataFrame:
    """Share and count of nulls per column in one pass, largest first, ties by name."""
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in names])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in names]
    long = wide.select("__n", F.explode(F.array(*cells)).alias("c")).select(
        "c.column", "c.missing", F.expr("coalesce(try_divide(c.missing, __n), 0D)").alias("share")
    )
    ordered = long.orderBy(F.desc("share"), "column")
    return ordered if n is None else ordered.limit(n)


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null keys count as equal. Copies combine before the shuffle."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def layer_report(telemetry: DataFrame, incidents: DataFrame, machines: DataFrame, maintenance: DataFrame) -> dict[str, DataFrame]:
    """Every report table of one layer; the frames come from ``sources.layers.load_layer_frames``."""
    return {
        "incidents_per_day": incidents_per_day(incidents),
        "weekday_hour": weekday_hour_matrix(incidents),
        **({"incidents_per_shift": value_counts(incidents, "shift")} if "shift" in incidents.columns else {}),
        "incidents_per_severity": value_counts(incidents, "severity"),
        "top_machines": top_machines(incidents),
        "severity_by_type": severity_by_type(incidents),
        "comment_presence": comment_presence(incidents),
        "frequent_comments": frequent_comments(incidents),
        "box_summary": box_summary(telemetry),
        "signal_correlation": correlations(telemetry, RAW_SIGNALS),
        "incident_correlation": signal_incident_correlations(telemetry, incidents),
        "machine_volumes": machine_volumes_long(incidents, maintenance),
        "machine_component": machine_component_matrix(maintenance),
        "machines_per_criticality": value_counts(machines, "criticality"),
        "telemetry_missing": missing_share(telemetry),
        "telemetry_duplicates": duplicate_count(telemetry, ["machine_id", "timestamp"]),
        "incident_missing": missing_share(incidents),
    }
