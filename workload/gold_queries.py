"""The machine-hour spine and every feature family, each checked against its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import features as ft
from millwright.operators import hourly as hr
from millwright.operators import impute as im
from millwright.operators.clean import build_silver_telemetry
from millwright.plans.gold import build_gold
from millwright.schemas import (
    GOLD_COLUMNS, HOURLY_COLUMNS, LABEL_HOURS, MACHINE_ATTRIBUTES, MEMORY_HOURS, SIGNALS, TYPE_COLUMNS,
)
from workload.registry import big, query, r, rounded, rs
from workload.views import over, view, with_views

KEYS = "machine_id_std, window_start"


def _silver(spark, sf):
    return build_silver_telemetry(view(spark, sf, "telemetry_v"))


def _hourly(spark, sf):
    return hr.aggregate_hourly(_silver(spark, sf))


def _split(spark, sf):
    return hr.split_hourly_grid(_hourly(spark, sf))


def _filled(spark, sf):
    return im.impute_hourly_signals(_split(spark, sf))


def _sources(spark, sf):
    return _silver(spark, sf), *(view(spark, sf, v) for v in ("incidents_v", "machine_v", "maintenance_v"))


def _gold(spark, sf, **options):
    return build_gold(*_sources(spark, sf), **options)


@query(with_views(
    "SELECT machine_id, timestamp, machine_id_std, window_start, pieces_produced, "
    + rs(["temperature_c", "pressure_bar", "voltage_mean_v", "rotation_mean_rpm"]) + " FROM silver_t", "silver_t"))
def silver_telemetry(spark, sf):
    return rounded(_silver(spark, sf))


@query(with_views(f"SELECT {KEYS}, {rs(HOURLY_COLUMNS)} FROM hourly", "hourly"))
def hourly_aggregate(spark, sf):
    return rounded(_hourly(spark, sf))


INC = ["incident_count_1h", "incident_max_severity_1h", *TYPE_COLUMNS]


@query(with_views(f"SELECT {KEYS}, {', '.join(INC)} FROM inc_h", "inc_h"))
def incident_hourly(spark, sf):
    return hr.aggregate_incidents(view(spark, sf, "incidents_v"))


@query(with_views(f"SELECT {KEYS}, maintenance_count_1h FROM maint_h", "maint_h"))
def maintenance_hourly(spark, sf):
    return hr.aggregate_maintenance(view(spark, sf, "maintenance_v"))


@query(with_views("SELECT * FROM bounds", "bounds"))
def machine_hour_bounds(spark, sf):
    return hr.machine_bounds(_hourly(spark, sf))


@query(with_views(f"SELECT {KEYS}, {rs(HOURLY_COLUMNS)} FROM grid", "grid"))
def complete_grid(spark, sf):
    return rounded(hr.complete_hourly_grid(_hourly(spark, sf)))


@query(with_views(f"SELECT {r('q70')}, {r('q85')} FROM thr", "thr"))
def split_quantiles(spark, sf):
    bounds = hr.machine_bounds(_hourly(spark, sf))
    found = hr.split_thresholds(hr.grid_rows_per_hour(bounds))
    return rounded(found.select(F.col("q0").alias("q70"), F.col("q1").alias("q85")))


@query(with_views(f"SELECT {KEYS}, split_set FROM split", "split"))
def temporal_split(spark, sf):
    return hr.add_temporal_split(hr.complete_hourly_grid(_hourly(spark, sf))).select("machine_id_std", "window_start", "split_set")


@query(with_views(f"SELECT {rs(HOURLY_COLUMNS)} FROM med", "med"))
def train_median_fill_values(spark, sf):
    fitted = im.train_medians(_split(spark, sf), HOURLY_COLUMNS, F.col("split_set") == "train")
    return rounded(fitted.select(*[F.col(f"{c}__median").alias(c) for c in HOURLY_COLUMNS]))


@query(with_views(f"SELECT {KEYS}, split_set, {rs(HOURLY_COLUMNS)} FROM filled", "filled"))
def gap_imputation(spark, sf):
    return rounded(_filled(spark, sf))


CAUSAL = ", ".join(
    r(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY machine_id_std ORDER BY window_start "
      f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), (SELECT {c} FROM med))", c)
    for c in HOURLY_COLUMNS
)


@query(with_views(f"SELECT {KEYS}, split_set, {CAUSAL} FROM split", "split", "med"))
def gap_imputation_causal(spark, sf):
    return rounded(im.impute_hourly_signals(_split(spark, sf), causal=True))


@query(with_views(f"SELECT {KEYS}, {', '.join(MACHINE_ATTRIBUTES)} FROM context", "context"))
def machine_reference_join(spark, sf):
    grid = hr.complete_hourly_grid(_hourly(spark, sf)).select("machine_id_std", "window_start")
    return ft.add_machine_reference(grid, view(spark, sf, "machine_v"))


SINCE = ("CASE WHEN max(CASE WHEN {c} > 0 THEN h END) {w} IS NULL THEN -1.0E0 "
         "ELSE (h - max(CASE WHEN {c} > 0 THEN h END) {w}){div} END")
UPTO = "OVER (PARTITION BY machine_id_std ORDER BY window_start ROWS UNBOUNDED PRECEDING)"
INCIDENT_SQL = ", ".join([
    *INC,
    big(f"sum(incident_count_1h) {over(23)}", "incident_count_prev_24h"),
    f"max(incident_max_severity_1h) {over(23)} AS incident_max_severity_prev_24h",
    big(f"sum(incident_count_1h) {over(167)}", "incident_count_prev_7d"),
    *[big(f"sum({c}) {over(23)}", f"{c}_count_prev_24h") for c in TYPE_COLUMNS],
    r(SINCE.format(c="incident_count_1h", w=UPTO, div=""), "hours_since_last_incident"),
])
MAINTENANCE_SQL = ", ".join([
    "maintenance_count_1h",
    big(f"sum(maintenance_count_1h) {over(719)}", "maintenance_count_prev_30d"),
    r(SINCE.format(c="maintenance_count_1h", w=UPTO, div=" / 24.0E0"), "days_since_last_maintenance"),
])


@query(with_views(f"SELECT {KEYS}, {INCIDENT_SQL} FROM context", "context"))
def incident_context(spark, sf):
    grid = hr.complete_hourly_grid(_hourly(spark, sf)).select("machine_id_std", "window_start")
    return rounded(ft.add_incident_context(grid, view(spark, sf, "incidents_v")))


@query(with_views(f"SELECT {KEYS}, {MAINTENANCE_SQL} FROM context", "context"))
def maintenance_context(spark, sf):
    grid = hr.complete_hourly_grid(_hourly(spark, sf)).select("machine_id_std", "window_start")
    return rounded(ft.add_maintenance_context(grid, view(spark, sf, "maintenance_v")))


def _memory(p):
    x = f"{p}_mean_1h"
    for n in MEMORY_HOURS:
        w = over(n - 1)
        yield r(f"avg({x}) {w}", f"{p}_mean_{n}h")
        yield r(f"max({x}) {w}", f"{p}_max_{n}h")
        yield r(f"CASE WHEN max({x}) {w} = min({x}) {w} THEN 0 ELSE coalesce(stddev_samp({x}) {w}, 0) END", f"{p}_std_{n}h")


def _trend(p):
    x = f"{p}_mean_1h"
    for name, k in (("trend_6h", 6), ("delta_1h", 1), ("delta_3h", 3)):
        lag = f"lag({x}, {k}) OVER (PARTITION BY machine_id_std ORDER BY window_start)"
        yield r(f"coalesce({x} - {lag}, 0)", f"{p}_{name}")


def _rolling_z(p):
    x, w = f"{p}_mean_1h", over(23)
    return r(f"CASE WHEN max({x}) {w} = min({x}) {w} THEN 0 ELSE coalesce(({x} - avg({x}) {w}) / nullif(stddev_samp({x}) {w}, 0), 0) END",
             f"{p}_zscore_24h")


def _machine_z(p):
    x = f"{p}_mean_1h"
    return r(f"CASE WHEN {p}_tc THEN 0 ELSE coalesce(({x} - {p}_tm) / nullif({p}_ts, 0), 0) END", f"{p}_zscore_machine")


MEMORY_SQL = ", ".join(c for p in SIGNALS for c in _memory(p))
TREND_SQL = ", ".join(c for p in SIGNALS for c in _trend(p))
ZSCORE_SQL = ", ".join(f"{_rolling_z(p)}, {_machine_z(p)}" for p in SIGNALS)
PRODUCTION_SQL = (
    r(f"sum(pieces_produced_1h) {over(23)}", "pieces_produced_sum_24h") + ", "
    + r("CASE WHEN coalesce(max_hourly_capacity_pieces, 0) > 0 THEN 100 * pieces_produced_1h / max_hourly_capacity_pieces ELSE 0 END",
        "capacity_utilization_pct")
)


def _labels(first):
    for h in LABEL_HOURS:
        w = (f"OVER (PARTITION BY machine_id_std ORDER BY window_start "
             f"ROWS BETWEEN {first} FOLLOWING AND {first + h - 1} FOLLOWING)")
        yield big(f"coalesce(sum(incident_count_1h) {w}, 0)", f"future_incident_count_{h}h")
        yield f"coalesce(sum(incident_count_1h) {w}, 0) > 0 AS label_failure_next_{h}h"


LABEL_SQL = ", ".join(_labels(0))
FEATURES = ["machine_id_std", "window_start"]


@query(with_views(f"SELECT {KEYS}, {MEMORY_SQL} FROM filled", "filled"))
def rolling_memory(spark, sf):
    done = ft.add_memory_features(_filled(spark, sf))
    return rounded(done.select(*FEATURES, *[f"{p}_{s}_{n}h" for p in SIGNALS for n in MEMORY_HOURS for s in ("mean", "max", "std")]))


@query(with_views(f"SELECT {KEYS}, {TREND_SQL} FROM filled", "filled"))
def trend_deltas(spark, sf):
    done = ft.add_trend_features(_filled(spark, sf))
    return rounded(done.select(*FEATURES, *[f"{p}_{n}" for p in SIGNALS for n in ("trend_6h", "delta_1h", "delta_3h")]))


@query(with_views(f"SELECT f.machine_id_std, f.window_start, {ZSCORE_SQL} FROM (SELECT * FROM filled LEFT JOIN base USING (machine_id_std)) f",
                  "filled", "base"))
def anomaly_zscores(spark, sf):
    done = ft.add_anomaly_features(_filled(spark, sf))
    return rounded(done.select(*FEATURES, *[f"{p}_{n}" for p in SIGNALS for n in ("zscore_24h", "zscore_machine")]))


@query(with_views("SELECT machine_id_std, " + ", ".join(f"{r(p + '_tm', p + '_mean')}, {r(f'CASE WHEN {p}_tc AND {p}_ts IS NOT NULL THEN 0 ELSE {p}_ts END', p + '_std')}" for p in SIGNALS) + " FROM base", "base"))
def train_baseline(spark, sf):
    found = ft.train_baseline(_filled(spark, sf))
    cols = [F.col(f"{p}__train_{s}").alias(f"{p}_{s}") for p in SIGNALS for s in ("mean", "std")]
    return rounded(found.select("machine_id_std", *cols))


@query(with_views(f"SELECT {KEYS}, {PRODUCTION_SQL} FROM context", "context"))
def production_load(spark, sf):
    rows = ft.add_machine_reference(_filled(spark, sf), view(spark, sf, "machine_v"))
    done = ft.add_production_features(rows)
    return rounded(done.select(*FEATURES, "pieces_produced_sum_24h", "capacity_utilization_pct"))


LABELS = [f"{n}_{h}h" for h in LABEL_HOURS for n in ("future_incident_count", "label_failure_next")]


def _counted_grid(spark, sf):
    grid = hr.complete_hourly_grid(_hourly(spark, sf)).select("machine_id_std", "window_start")
    counts = hr.aggregate_incidents(view(spark, sf, "incidents_v")).select(*FEATURES, "incident_count_1h")
    return grid.join(counts, FEATURES, "left").fillna(0, ["incident_count_1h"])


@query(with_views(f"SELECT {KEYS}, window_start + INTERVAL 1 HOUR AS window_end, {LABEL_SQL} FROM context", "context"))
def future_labels(spark, sf):
    return ft.add_future_labels(_counted_grid(spark, sf)).select(*FEATURES, "window_end", *LABELS)


@query(with_views(f"SELECT {KEYS}, {', '.join(_labels(1))} FROM context", "context"))
def future_labels_next_hours_only(spark, sf):
    return ft.add_future_labels(_counted_grid(spark, sf), include_current=False).select(*FEATURES, *LABELS)


@query(with_views(
    f"SELECT {KEYS}, " + ", ".join(
        f"f{h} AS future_incident_count_{h}h, CASE WHEN f{h} > 0 THEN true WHEN e{h} IS NULL THEN NULL ELSE false END AS label_failure_next_{h}h"
        for h in LABEL_HOURS)
    + f" FROM (SELECT {KEYS}, " + ", ".join(
        f"{big(f'sum(incident_count_1h) {over(0, h - 1)}', f'f{h}')}, lead(1, {h - 1}) OVER (PARTITION BY machine_id_std ORDER BY window_start) AS e{h}"
        for h in LABEL_HOURS) + " FROM context)", "context"))
def future_labels_censored(spark, sf):
    done = ft.add_future_labels(_counted_grid(spark, sf), censored=True)
    return done.select(*FEATURES, *LABELS)


GOLD_SQL = with_views(
    f"SELECT {KEYS}, window_start + INTERVAL 1 HOUR AS window_end, split_set, {rs(HOURLY_COLUMNS)}, "
    f"{', '.join(MACHINE_ATTRIBUTES)}, {INCIDENT_SQL}, {MAINTENANCE_SQL}, {MEMORY_SQL}, {TREND_SQL}, {ZSCORE_SQL}, "
    f"{PRODUCTION_SQL}, {LABEL_SQL} FROM (SELECT * FROM context LEFT JOIN base USING (machine_id_std))",
    "context", "base")


@query(GOLD_SQL)
def gold_dataset(spark, sf):
    gold = _gold(spark, sf)
    assert gold.columns == GOLD_COLUMNS
    return rounded(gold)
