"""Report tables R1-R17 and the aggregations behind them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from millwright.operators import contracts as ct
from millwright.operators import reports as rp
from millwright.schemas import HOURLY_COLUMNS, LABEL_HOURS, RAW_SIGNALS, TYPE_COLUMNS
from millwright.sources.layers import normalize_machine_column
from workload.gold_queries import _counted_grid, _filled, _gold, _silver, _split, LABEL_SQL
from workload.registry import big, query, r, rounded
from workload.views import view, with_views

def _incidents(spark, sf):
    return view(spark, sf, "incidents_v")


def _telemetry(spark, sf):
    return view(spark, sf, "telemetry_v")


def _maintenance(spark, sf):
    return normalize_machine_column(view(spark, sf, "maintenance_v"))


@query(with_views("""SELECT CAST(d.day AS DATE) AS day, count(i.incident_id) AS incidents
FROM (SELECT unnest(generate_series(min(CAST(incident_at AS DATE)), max(CAST(incident_at AS DATE)), INTERVAL 1 DAY)) AS day FROM incidents_v) d
LEFT JOIN incidents_v i ON CAST(i.incident_at AS DATE) = CAST(d.day AS DATE) GROUP BY 1""", "incidents_v"))
def report_incidents_per_day(spark, sf):
    return rp.incidents_per_day(_incidents(spark, sf))


HOUR_CELLS = ", ".join(f"count(*) FILTER (hour(incident_at) = {h}) AS h{h:02d}" for h in range(24))


@query(with_views(f"SELECT dayname(incident_at) AS weekday, {HOUR_CELLS} FROM incidents_v GROUP BY 1", "incidents_v"))
def report_weekday_hour(spark, sf):
    return rp.weekday_hour_matrix(_incidents(spark, sf))


@query(with_views("SELECT shift, count(*) AS n FROM incidents_v WHERE shift IS NOT NULL GROUP BY 1", "incidents_v"))
def report_incidents_per_shift(spark, sf):
    return rp.value_counts(_incidents(spark, sf), "shift")


@query(with_views("SELECT severity, count(*) AS n FROM incidents_v WHERE severity IS NOT NULL GROUP BY 1", "incidents_v"))
def report_incidents_per_severity(spark, sf):
    return rp.value_counts(_incidents(spark, sf), "severity")


@query(with_views(f"SELECT machine_id, count(severity) AS count, {r('avg(severity)', 'mean')} FROM incidents_v "
                  "GROUP BY 1 ORDER BY count(severity) DESC, machine_id LIMIT 15", "incidents_v"))
def report_top_machines(spark, sf):
    return rounded(rp.top_machines(_incidents(spark, sf)))


@query(with_views(f"SELECT severity, {', '.join(big(f'sum({c})', c) for c in TYPE_COLUMNS)} FROM incidents_v GROUP BY 1", "incidents_v"))
def report_severity_by_type(spark, sf):
    return rp.severity_by_type(_incidents(spark, sf))


@query(with_views("SELECT CASE WHEN trim(coalesce(comment, '')) = '' THEN 'empty' ELSE 'comment' END AS status, count(*) AS n "
                  "FROM incidents_v GROUP BY 1", "incidents_v"))
def report_comment_presence(spark, sf):
    return rp.comment_presence(_incidents(spark, sf))


@query(with_views("SELECT trim(comment) AS comment, count(*) AS n FROM incidents_v WHERE trim(coalesce(comment, '')) <> '' "
                  "GROUP BY 1 ORDER BY count(*) DESC, trim(comment) LIMIT 20", "incidents_v"))
def report_frequent_comments(spark, sf):
    return rp.frequent_comments(_incidents(spark, sf))


LONG_SIGNALS = " UNION ALL ".join(f"SELECT machine_id, '{s}' AS signal, CAST({s} AS DOUBLE) AS x FROM telemetry_v" for s in RAW_SIGNALS)


@query(with_views(f""", long AS MATERIALIZED ({LONG_SIGNALS}),
q AS MATERIALIZED (SELECT machine_id, signal, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
 FROM long WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT machine_id, signal, {r('max(q1)', 'q1')}, {r('max(median)', 'median')}, {r('max(q3)', 'q3')},
 {r('min(x) FILTER (x BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1))', 'whisker_low')},
 {r('max(x) FILTER (x BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1))', 'whisker_high')},
 count(*) FILTER (NOT (x BETWEEN q1 - 1.5E0 * (q3 - q1) AND q3 + 1.5E0 * (q3 - q1))) AS outliers
FROM long JOIN q USING (machine_id, signal) WHERE x IS NOT NULL GROUP BY 1, 2""", "telemetry_v"))
def report_box_summary(spark, sf):
    return rounded(rp.box_summary(_telemetry(spark, sf)))


def _corr_sql(columns, source):
    cells = [f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))', 'corr')} FROM {source}" for a, b in combinations(columns, 2)]
    return " UNION ALL ".join(cells)


@query(with_views(f""", whole AS MATERIALIZED (SELECT * FROM telemetry_v WHERE {' AND '.join(f'{s} IS NOT NULL' for s in RAW_SIGNALS)})
{_corr_sql(RAW_SIGNALS, 'whole')}""", "telemetry_v"))
def report_signal_correlation(spark, sf):
    return rounded(rp.correlations(_telemetry(spark, sf), RAW_SIGNALS))


@query(with_views(f""", hc AS MATERIALIZED (SELECT machine_id, window_start AS timestamp, count(*) AS incidents FROM incidents_v GROUP BY 1, 2),
j AS MATERIALIZED (SELECT t.*, coalesce(h.incidents, 0) AS incidents FROM telemetry_v t
 LEFT JOIN hc h ON h.machine_id = t.machine_id AND h.timestamp = t.timestamp)
{_corr_sql([*RAW_SIGNALS, 'incidents'], 'j')}""", "telemetry_v", "incidents_v"))
def report_incident_correlation(spark, sf):
    return rounded(rp.signal_incident_correlations(_telemetry(spark, sf), _incidents(spark, sf)))


@query(with_views("""SELECT t.row_seq, t.machine_id, t.timestamp, coalesce(h.incidents, 0) AS incidents FROM telemetry_v t
LEFT JOIN (SELECT machine_id, window_start AS timestamp, count(*) AS incidents FROM incidents_v GROUP BY 1, 2) h
 ON h.machine_id = t.machine_id AND h.timestamp = t.timestamp""", "telemetry_v", "incidents_v"))
def telemetry_with_incident_counts(spark, sf):
    joined = rp.with_incident_counts(_telemetry(spark, sf), _incidents(spark, sf))
    return joined.select("row_seq", "machine_id", "timestamp", "incidents")


VOLUMES = """, i AS (SELECT machine_id, count(*) AS incidents FROM incidents_v GROUP BY 1),
a AS (SELECT machine_code AS machine_id, count(*) AS maintenances FROM maintenance_v GROUP BY 1),
v AS MATERIALIZED (SELECT coalesce(i.machine_id, a.machine_id) AS machine_id, coalesce(incidents, 0) AS incidents,
 coalesce(maintenances, 0) AS maintenances FROM i FULL OUTER JOIN a ON a.machine_id = i.machine_id)
"""


@query(with_views(VOLUMES + "SELECT * FROM v", "incidents_v", "maintenance_v"))
def machine_volumes(spark, sf):
    return rp.machine_volumes(_incidents(spark, sf), _maintenance(spark, sf))


@query(with_views(VOLUMES + "SELECT machine_id, 'incidents' AS indicator, incidents AS n FROM v UNION ALL "
                  "SELECT machine_id, 'maintenances', maintenances FROM v", "incidents_v", "maintenance_v"))
def report_machine_volumes(spark, sf):
    return rp.machine_volumes_long(_incidents(spark, sf), _maintenance(spark, sf))


COMPONENTS = [f"component-{i}" for i in range(11)]


@query(with_views("SELECT machine_code AS machine_id, " + ", ".join(
    f"count(*) FILTER (component = '{c}') AS \"{c}\"" for c in COMPONENTS) + " FROM maintenance_v GROUP BY 1", "maintenance_v"))
def report_machine_component(spark, sf):
    return rp.machine_component_matrix(_maintenance(spark, sf), COMPONENTS)


@query(with_views("SELECT criticality, count(*) AS n FROM machine_v GROUP BY 1", "machine_v"))
def report_machines_per_criticality(spark, sf):
    return rp.value_counts(view(spark, sf, "machine_v"), "criticality")


TELEMETRY_COLS = ["row_seq", "machine_id", "timestamp", *RAW_SIGNALS]
INCIDENT_COLS = ["incident_id", "operator_badge", "machine_id", "machine_id_std", "incident_at", "window_start", "severity",
                 "comment", "shift", *TYPE_COLUMNS]


def _missing_sql(columns, source, where=""):
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing, {r(f'count(*) FILTER ({c} IS NULL) / count(*)', 'share')} FROM {source}"
        for c in columns)
    return f"SELECT * FROM ({cells}) {where}"


@query(with_views(_missing_sql(TELEMETRY_COLS, "telemetry_v", 'ORDER BY missing DESC, "column" LIMIT 20'), "telemetry_v"))
def report_telemetry_missing(spark, sf):
    return rounded(rp.missing_share(_telemetry(spark, sf)))


@query(with_views(_missing_sql(INCIDENT_COLS, "incidents_v", 'ORDER BY missing DESC, "column" LIMIT 20'), "incidents_v"))
def report_incident_missing(spark, sf):
    return rounded(rp.missing_share(_incidents(spark, sf)))


@query(with_views(_missing_sql(TELEMETRY_COLS, "telemetry_v", "WHERE missing > 0"), "telemetry_v"))
def missing_summary(spark, sf):
    return rounded(ct.missing_summary(_telemetry(spark, sf)))


@query(with_views("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM "
                  "(SELECT count(*) AS n FROM telemetry_v GROUP BY machine_id, timestamp)", "telemetry_v"))
def report_telemetry_duplicates(spark, sf):
    return rp.duplicate_count(_telemetry(spark, sf), ["machine_id", "timestamp"])


@query(with_views("SELECT split_set, count(*) AS n, min(window_start) AS first_hour, max(window_start) AS last_hour FROM split GROUP BY 1", "split"))
def split_distribution(spark, sf):
    return ct.split_distribution(_split(spark, sf))


@query(with_views("SELECT " + ", ".join(f"count(*) FILTER (label_failure_next_{h}h) AS label_failure_next_{h}h" for h in LABEL_HOURS)
                  + f" FROM (SELECT {LABEL_SQL} FROM context)", "context"))
def label_positive_counts(spark, sf):
    from millwright.operators.features import add_future_labels

    return ct.label_positives(add_future_labels(_counted_grid(spark, sf)))


@query(with_views("SELECT (SELECT CAST(sum(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in HOURLY_COLUMNS)
                  + ") AS BIGINT) FROM split) AS missing_before, (SELECT CAST(sum("
                  + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in HOURLY_COLUMNS)
                  + ") AS BIGINT) FROM filled) AS missing_after", "split", "filled"))
def imputation_totals(spark, sf):
    before = ct.missing_total(_split(spark, sf), HOURLY_COLUMNS, "missing_before")
    return before.crossJoin(F.broadcast(ct.missing_total(_filled(spark, sf), HOURLY_COLUMNS, "missing_after")))


@query(with_views("SELECT count(*) AS telemetry_rows, count(timestamp) AS telemetry_rows_usable, count(DISTINCT machine_id) AS machines, "
                  "(SELECT count(*) FROM incidents_v) AS row_count, (SELECT count(*) FROM machine_v) AS reference_machines, "
                  "(SELECT count(*) FROM maintenance_v) AS maintenances FROM telemetry_v",
                  "telemetry_v", "incidents_v", "machine_v", "maintenance_v"))
def layer_run_metrics(spark, sf):
    return ct.layer_metrics({"telemetry": _telemetry(spark, sf), "incidents": _incidents(spark, sf),
                             "machines": view(spark, sf, "machine_v"), "maintenance": _maintenance(spark, sf)})


@query(with_views("SELECT count(*) AS row_count, count(DISTINCT machine_id_std) AS machines, "
                  "count(*) FILTER (split_set = 'train') AS train, count(*) FILTER (split_set = 'validation') AS validation, "
                  "count(*) FILTER (split_set = 'test') AS test FROM split", "split"))
def gold_run_metrics(spark, sf):
    m = ct.gold_metrics(_split(spark, sf))
    return m.select("row_count", "machines", *[F.col("split_counts")[s].alias(s) for s in ("train", "validation", "test")])


@query(with_views("""SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS null_identifiers,
 CAST(7 * count(*) FILTER (model IS NULL) AS BIGINT) AS nulls, 113 AS columns FROM context""", "context"))
def gold_contract(spark, sf):
    return ct.gold_checks(_gold(spark, sf))


ORDER_RULES = """
SELECT 'not_null:o_custkey' AS rule, count(*) FILTER (o_custkey IS NULL) AS violations FROM orders
UNION ALL SELECT 'check:positive_total', count(*) FILTER (NOT o_totalprice > 100000) FROM orders
UNION ALL SELECT 'check:known_status', count(*) FILTER (NOT o_orderstatus IN ('F', 'O')) FROM orders
UNION ALL SELECT 'unique:o_orderkey', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
UNION ALL SELECT 'unique:o_custkey,o_orderstatus', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)
UNION ALL SELECT 'foreign_key:o_custkey', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = o.o_custkey)
"""


@query(ORDER_RULES)
def table_constraints(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return ct.expectations(
        orders,
        not_null=["o_custkey"],
        unique=[["o_orderkey"], ["o_custkey", "o_orderstatus"]],
        checks={"positive_total": F.col("o_totalprice") > 100000, "known_status": F.col("o_orderstatus").isin("F", "O")},
        foreign_keys={"o_custkey": (spark.read.parquet(f"{sf}/supplier.parquet"), "s_suppkey")},
    )


@query(with_views("""SELECT 'not_null:temperature_c' AS rule, count(*) FILTER (temperature_c IS NULL) AS violations FROM telemetry_v
UNION ALL SELECT 'not_null:timestamp', count(*) FILTER (timestamp IS NULL) FROM telemetry_v
UNION ALL SELECT 'unique:machine_id,timestamp', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM telemetry_v GROUP BY machine_id, timestamp)
UNION ALL SELECT 'foreign_key:machine_id', count(*) FROM telemetry_v t WHERE NOT EXISTS (SELECT 1 FROM machine_v m WHERE m.machine_code = t.machine_id)""",
                  "telemetry_v", "machine_v"))
def telemetry_constraints(spark, sf):
    return ct.expectations(_telemetry(spark, sf), not_null=["temperature_c", "timestamp"], unique=[["machine_id", "timestamp"]],
                           foreign_keys={"machine_id": (view(spark, sf, "machine_v"), "machine_code")})


@query(with_views(f"SELECT {', '.join(c for c in TELEMETRY_COLS if c not in RAW_SIGNALS[:4])}, {', '.join(r(c) for c in RAW_SIGNALS[:4])} "
                  "FROM telemetry_v WHERE temperature_c IS NULL OR voltage_mean_v IS NULL", "telemetry_v"))
def incomplete_rows(spark, sf):
    return rounded(ct.incomplete_rows(_telemetry(spark, sf)))


@query(with_views("SELECT row_seq, concat_ws('; ', CASE WHEN temperature_c IS NULL THEN 'temperature_c' END, "
                  "CASE WHEN voltage_mean_v IS NULL THEN 'voltage_mean_v' END) AS missing_columns FROM telemetry_v", "telemetry_v"))
def missing_column_list(spark, sf):
    return ct.with_missing_list(_telemetry(spark, sf), RAW_SIGNALS).select("row_seq", "missing_columns")
