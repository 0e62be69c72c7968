"""Data contracts: required columns, table rules as violation counts, gold checks, run metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millwright.functions.storage import attach_row
from millwright.schemas import GOLD_IDS, GOLD_LABELS, LAYER_TABLES, SPLIT_NAMES


class ContractError(ValueError):
    """A table breaks its contract."""


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{what} lacks columns: {missing}")
    return df


def column_contract(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, present, violations): each required column, and how many rows lack it or its value."""
    found = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count(c).alias(c) for c in required if c in df.columns))
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"),
                 (F.col("__rows") - (F.col(c) if c in df.columns else F.lit(0))).alias("violations"))
        for c in required
    ]
    return found.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def require_layer(layer: str, allowed: Sequence[str] = (*LAYER_TABLES, "all"), persist: bool = True) -> str:
    layer = layer.lower()
    if layer not in allowed:
        raise ContractError(f"layer must be one of {', '.join(allowed)}, not {layer!r}")
    if not persist and layer != "gold":
        raise ContractError("running without stored layers is possible for gold only")
    return layer


def expectations(
    df: DataFrame,
    not_null: Sequence[str] = (),
    unique: Sequence[Sequence[str]] = (),
    checks: Mapping[str, Column] | None = None,
    foreign_keys: Mapping[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """One row per rule with its violation count.

    A check that evaluates to null is not a violation, as in SQL. Key copies and foreign-key values are
    counted per distinct value before anything is joined, so a hot key is one row there.
    """
    rules = {f"not_null:{c}": F.col(c).isNull() for c in not_null}
    rules |= {f"check:{name}": ~rule for name, rule in (checks or {}).items()}
    parts = []
    if rules:
        wide = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in rules.items()])
        cells = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
        parts.append(wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
    for keys in unique:
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        total = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))
        parts.append(groups.agg(total.alias("violations")).select(F.lit(f"unique:{','.join(keys)}").alias("rule"), "violations"))
    for column, (parent, parent_key) in (foreign_keys or {}).items():
        values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        known = parent.select(F.col(parent_key).alias(column)).distinct()
        orphans = values.join(known, column, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        parts.append(orphans.select(F.lit(f"foreign_key:{column}").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def enforce(report: DataFrame) -> None:
    """Raise when any rule of an ``expectations`` report is broken (the report has one row per rule)."""
    broken = report.filter(F.col("violations") > 0).collect()
    if broken:
        raise ContractError("; ".join(f"{row['rule']}: {row['violations']} rows" for row in broken))


def incident_time_violations(incidents: DataFrame) -> DataFrame:
    """The incidents without a readable date and time, with what stands in their place."""
    at = F.to_timestamp_ntz(F.concat_ws(" ", F.col("date").cast("string"), F.col("time").cast("string"))) if "incident_at" not in incidents.columns else F.col("incident_at")
    return incidents.where(at.isNull())


def require_incident_times(incidents: DataFrame) -> DataFrame:
    """Every silver incident needs a timestamp."""
    bad = incidents.agg(F.count(F.when(F.col("incident_at").isNull(), 1))).head()[0]
    if bad:
        raise ContractError(f"{bad} incidents have no readable date and time")
    return incidents


def gold_checks(gold: DataFrame) -> DataFrame:
    """One row: duplicate machine-hours, rows with a null identifier, nulls in all columns, column count."""
    keys = ["machine_id_std", "window_start"]
    null_id = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in GOLD_IDS])
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in gold.columns])
    groups = gold.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(null_id.cast("long")).alias("null_id"), F.sum(nulls).alias("nulls")
    )
    zero = F.lit(0)
    return groups.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicates"),
        F.coalesce(F.sum("null_id"), zero).alias("null_identifiers"),
        F.coalesce(F.sum("nulls"), zero).alias("nulls"),
    ).withColumn("columns", F.lit(len(gold.columns)))


def observe_gold(gold: DataFrame) -> tuple[DataFrame, Observation]:
    """``gold``, and what its next action counts on the way: rows, null identifiers, nulls, rows per split.

    Rows are counted by the tasks that write them, so nothing is read again. A split of another name counts as ``other``.
    """
    null_id = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in GOLD_IDS])
    nulls = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in gold.columns])
    known = F.col("split_set").isin(*SPLIT_NAMES)
    counts = [F.count(F.lit(1)).alias("rows"), F.count(F.when(null_id, 1)).alias("null_identifiers"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls")]
    counts += [F.count(F.when(F.col("split_set") == name, 1)).alias(f"split:{name}") for name in SPLIT_NAMES]
    counts += [F.count(F.when(~known, 1)).alias("split:other")]
    seen = Observation()
    return gold.observe(seen, *counts), seen


def key_copies(gold: DataFrame) -> DataFrame:
    """One row: machines, and machine-hours that came before. Only the two key columns are read."""
    hours = gold.groupBy("machine_id_std", "window_start").agg(F.count(F.lit(1)).alias("n"))
    machines = hours.groupBy("machine_id_std").agg(F.sum(F.col("n") - 1).alias("again"))
    return machines.agg(F.count("machine_id_std").alias("machines"), F.coalesce(F.sum("again"), F.lit(0)).alias("duplicates"))


def require_gold(found: dict, min_columns: int = 90) -> dict:
    """Raise when the counts of a gold table break its contract; adds a warning for too few columns."""
    if found["duplicates"]:
        raise ContractError(f"gold has {found['duplicates']} duplicate machine-hours")
    if found["null_identifiers"]:
        raise ContractError(f"gold has {found['null_identifiers']} rows with incomplete identifiers")
    return found | {"warnings": [f"only {found['columns']} columns"] if found["columns"] < min_columns else []}


def validate_gold(gold: DataFrame, min_columns: int = 90) -> dict:
    """Raise on duplicates or null identifiers; returns the counts, with a warning for too few columns."""
    return require_gold(gold_checks(gold).head().asDict(), min_columns)


def validate_written(seen: Observation, stored: DataFrame, min_columns: int = 90) -> dict:
    """``validate_gold`` for a table that was just written through ``observe_gold``; also ``machines``."""
    return require_gold(seen.get | key_copies(stored).head().asDict() | {"columns": len(stored.columns)}, min_columns)


def split_distribution(gold: DataFrame) -> DataFrame:
    """Rows, first and last hour per split."""
    return gold.groupBy("split_set").agg(
        F.count(F.lit(1)).alias("n"), F.min("window_start").alias("first_hour"), F.max("window_start").alias("last_hour")
    )


def label_positives(gold: DataFrame) -> DataFrame:
    labels = [c for c in GOLD_LABELS if c.startswith("label_")]
    return gold.agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in labels])


def missing_total(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in columns])
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias(name))


def layer_metrics(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Run counts of a bronze or silver layer, one aggregation per frame."""
    telemetry = frames["telemetry"]
    machine = "machine_id_std" if "machine_id_std" in telemetry.columns else "machine_id"
    one = telemetry.agg(
        F.count(F.lit(1)).alias("telemetry_rows"),
        F.count("timestamp").alias("telemetry_rows_usable"),
        F.count_distinct(machine).alias("machines"),
    )
    for frame, name in (("incidents", "row_count"), ("machines", "reference_machines"), ("maintenance", "maintenances")):
        one = attach_row(one, frames[frame].agg(F.count(F.lit(1)).alias(name)))
    return one


def gold_metrics(gold: DataFrame) -> DataFrame:
    """Run counts of a gold table from one grouping by split."""
    per_machine = gold.groupBy("machine_id_std", "split_set").agg(F.count(F.lit(1)).alias("n"))
    one = per_machine.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count_distinct("machine_id_std").alias("machines")
    )
    splits = per_machine.groupBy("split_set").agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split_set", "n")))).alias("split_counts")
    )
    return attach_row(one, splits).withColumn("column_count", F.lit(len(gold.columns)))


def written_metrics(spark: SparkSession, found: dict) -> DataFrame:
    """The run counts of ``gold_metrics`` from the counts of ``validate_written``."""
    splits = {k.removeprefix("split:"): n for k, n in found.items() if k.startswith("split:") and n}
    row = (found["rows"], found["machines"], splits, found["columns"])
    return spark.createDataFrame([row], "row_count long, machines long, split_counts map<string, long>, column_count int")


def attached_totals(gold: DataFrame) -> DataFrame:
    """One row: how many incidents and maintenances the machine-hours hold."""
    return gold.agg(*[
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        for c, name in (("incident_count_1h", "incidents_attached"), ("maintenance_count_1h", "maintenances_attached"))
    ])


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first."""
    from millwright.operators.reports import missing_share

    return missing_share(df, None).filter(F.col("missing") > 0).select("column", "missing", "share")


def incomplete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns or df.columns]))


def with_missing_list(df: DataFrame, columns: Sequence[str] | None = None, name: str = "missing_columns") -> DataFrame:
    """The names of a row's null columns, joined by '; '."""
    names = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns or df.columns]
    return df.withColumn(name, F.concat_ws("; ", *names))
