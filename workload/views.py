"""Stand-in sources over the given tables: events play telemetry, incidents and maintenance, suppliers machines.

The view text is shared by Spark and DuckDB; ``{TS}`` is each engine's naive timestamp type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millwright.schemas import HOURLY_COLUMNS, SIGNALS, TYPE_COLUMNS

FLAGS = ",\n ".join(
    f"CAST(CASE WHEN event_id % {len(TYPE_COLUMNS)} = {i} THEN 1 ELSE 0 END AS INT) AS {c}"
    for i, c in enumerate(TYPE_COLUMNS)
)

VIEWS = {
    "telemetry_v": ("events", """
SELECT event_id AS row_seq,
 concat(CASE WHEN event_id % 5 = 0 THEN ' mach-' ELSE 'MACH-' END, CAST(user_id AS STRING)) AS machine_id,
 CAST(CASE WHEN event_id % 2 = 0 THEN date_trunc('hour', ts) ELSE ts END AS {TS}) AS timestamp,
 CASE WHEN event_id % 50 = 7 THEN NULL ELSE value END AS temperature_c,
 150.0E0 + CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS pressure_bar,
 CASE WHEN event_id % 40 = 9 THEN NULL ELSE 220.0E0 + (event_id % 17) END AS voltage_mean_v,
 1500.0E0 + (event_id % 101) AS rotation_mean_rpm,
 CAST(event_id % 9 AS INT) AS pieces_produced
FROM events"""),
    "incidents_v": ("events", f"""
SELECT concat('INC-', CAST(event_id AS STRING)) AS incident_id,
 concat('BADGE-', CAST(event_id % 23 AS STRING)) AS operator_badge,
 concat('MACH-', CAST(user_id AS STRING)) AS machine_id,
 concat('MACH-', CAST(user_id AS STRING)) AS machine_id_std,
 CAST(ts AS {{TS}}) AS incident_at, CAST(date_trunc('hour', ts) AS {{TS}}) AS window_start,
 CAST(1 + event_id % 4 AS INT) AS severity,
 CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN NULL
   ELSE concat('comment ', CAST(event_id % 30 AS STRING)) END AS comment,
 CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS shift,
 {FLAGS}
FROM events WHERE event_type = 'error'"""),
    "machine_v": ("supplier", """
SELECT concat('MACH-', CAST(s_suppkey AS STRING)) AS machine_code,
 CAST('2015-01-01' AS DATE) + CAST(s_suppkey % 3000 AS INT) AS commissioning_date,
 CAST(16 * (40 + s_suppkey % 50) AS INT) AS max_daily_capacity,
 CAST(40 + s_suppkey % 50 AS INT) AS max_hourly_capacity_pieces,
 concat('Model-', CAST(s_suppkey % 4 AS STRING)) AS model,
 concat('Line-', CAST(s_nationkey % 3 AS STRING)) AS production_line,
 concat('Hall-', CAST(s_nationkey % 5 AS STRING)) AS location,
 CASE s_suppkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS criticality
FROM supplier"""),
    "maintenance_v": ("events", """
SELECT event_id AS maintenance_id, concat('MACH-', CAST(user_id AS STRING)) AS machine_code,
 CAST(ts AS {TS}) AS maintenance_at, CAST(date_trunc('hour', ts) AS {TS}) AS maintenance_hour,
 CASE WHEN event_id % 20 = 0 THEN 'proactive' ELSE 'reactive' END AS maintenance_type,
 concat('component-', CAST(event_id % 11 AS STRING)) AS component,
 CAST(1.0E0 + (event_id % 7) * 0.25E0 AS DOUBLE) AS duration_hours
FROM events WHERE event_type = 'signup'"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, text = VIEWS[name]
    # date_trunc goes through the session zone; a fixed one keeps the views the same everywhere.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    frame = table(spark, sf_dir, source)
    body = text.replace("{TS}", "TIMESTAMP_NTZ").replace(f"FROM {source}", "FROM {source}")
    return spark.sql(body, source=frame)


# ---- the same chain in DuckDB SQL, as common table expressions in dependency order -----------------

LAST = "OVER (PARTITION BY machine_id_std ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
NEXT = "OVER (PARTITION BY machine_id_std ORDER BY window_start ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
HOURS = "CAST(epoch(window_start) / 3600 AS BIGINT)"


def _fill(column: str) -> str:
    lv = f"last_value({column} IGNORE NULLS) {LAST}"
    nv = f"first_value({column} IGNORE NULLS) {NEXT}"
    lh = f"last_value(CASE WHEN {column} IS NOT NULL THEN h END IGNORE NULLS) {LAST}"
    nh = f"first_value(CASE WHEN {column} IS NOT NULL THEN h END IGNORE NULLS) {NEXT}"
    value = (
        f"CASE WHEN {column} IS NOT NULL THEN {column} ELSE coalesce("
        f"{lv} + ({nv} - {lv}) / ({nh} - {lh}) * (h - {lh}), {lv}, {nv}, (SELECT {column} FROM med)) END"
    )
    return f"greatest({value}, 0.0E0)" if column.startswith("pieces") else value


_signal_aggs = ", ".join(
    f"avg({c}) AS {p}_mean_1h, max({c}) AS {p}_max_1h"
    for p, c in (("temp", "temperature_c"), ("pressure", "pressure_bar"),
                 ("voltage", "voltage_mean_v"), ("rotation", "rotation_mean_rpm"))
)

CHAIN = {
    "silver_t": """
SELECT * EXCLUDE (rn, temperature_c, row_seq),
 CASE WHEN temperature_c > 80 THEN (temperature_c - 32.0E0) * 5.0E0 / 9.0E0 ELSE temperature_c END AS temperature_c,
 date_trunc('hour', timestamp) AS window_start
FROM (SELECT *, upper(trim(machine_id)) AS machine_id_std,
  row_number() OVER (PARTITION BY upper(trim(machine_id)), timestamp ORDER BY row_seq) AS rn FROM telemetry_v)
WHERE rn = 1 AND timestamp IS NOT NULL""",
    "hourly": f"""
SELECT machine_id_std, window_start, {_signal_aggs}, coalesce(CAST(sum(pieces_produced) AS DOUBLE), 0.0E0) AS pieces_produced_1h
FROM silver_t WHERE machine_id_std IS NOT NULL GROUP BY 1, 2""",
    "inc_h": f"""
SELECT machine_id_std, window_start, count(incident_id) AS incident_count_1h, max(severity) AS incident_max_severity_1h,
 {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in TYPE_COLUMNS)}
FROM incidents_v GROUP BY 1, 2""",
    "maint_h": """
SELECT machine_code AS machine_id_std, maintenance_hour AS window_start, count(maintenance_id) AS maintenance_count_1h
FROM maintenance_v GROUP BY 1, 2""",
    "bounds": """
SELECT machine_id_std, min(window_start) AS first_hour, max(window_start) AS last_hour FROM hourly GROUP BY 1""",
    "grid": """
SELECT b.machine_id_std, g.w AS window_start, h.* EXCLUDE (machine_id_std, window_start)
FROM bounds b CROSS JOIN LATERAL (SELECT unnest(generate_series(b.first_hour, b.last_hour, INTERVAL 1 HOUR)) AS w) g
LEFT JOIN hourly h ON h.machine_id_std = b.machine_id_std AND h.window_start = g.w""",
    "thr": f"""
SELECT quantile_cont({HOURS}, 0.70) AS q70, quantile_cont({HOURS}, 0.85) AS q85 FROM grid""",
    "split": f"""
SELECT grid.*, {HOURS} AS h,
 CASE WHEN {HOURS} < (SELECT q70 FROM thr) THEN 'train' WHEN {HOURS} < (SELECT q85 FROM thr) THEN 'validation' ELSE 'test' END AS split_set
FROM grid""",
    "med": f"""
SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in HOURLY_COLUMNS)} FROM split WHERE split_set = 'train'""",
    "filled": f"""
SELECT machine_id_std, window_start, h, split_set, {', '.join(f'{_fill(c)} AS {c}' for c in HOURLY_COLUMNS)} FROM split""",
    "context": f"""
SELECT f.*, m.* EXCLUDE (machine_code), coalesce(i.incident_count_1h, 0) AS incident_count_1h,
 coalesce(i.incident_max_severity_1h, 0) AS incident_max_severity_1h,
 {', '.join(f'coalesce(i.{c}, 0) AS {c}' for c in TYPE_COLUMNS)},
 coalesce(a.maintenance_count_1h, 0) AS maintenance_count_1h
FROM filled f LEFT JOIN machine_v m ON m.machine_code = f.machine_id_std
LEFT JOIN inc_h i ON i.machine_id_std = f.machine_id_std AND i.window_start = f.window_start
LEFT JOIN maint_h a ON a.machine_id_std = f.machine_id_std AND a.window_start = f.window_start""",
    "base": f"""
SELECT machine_id_std, {', '.join(f'avg({p}_mean_1h) AS {p}_tm, stddev_samp({p}_mean_1h) AS {p}_ts, max({p}_mean_1h) = min({p}_mean_1h) AS {p}_tc' for p in SIGNALS)}
FROM filled WHERE split_set = 'train' GROUP BY 1""",
}


def over(back: int, ahead: int = 0) -> str:
    return (
        f"OVER (PARTITION BY machine_id_std ORDER BY window_start ROWS BETWEEN {back} PRECEDING AND "
        f"{f'{ahead} FOLLOWING' if ahead else 'CURRENT ROW'})"
    )


def with_views(select: str, *names: str) -> str:
    """``select`` preceded by the named stand-in views and chain steps, each with what it needs."""
    needs = {
        "silver_t": ["telemetry_v"], "hourly": ["silver_t"], "inc_h": ["incidents_v"], "maint_h": ["maintenance_v"],
        "bounds": ["hourly"], "grid": ["bounds", "hourly"], "thr": ["grid"], "split": ["grid", "thr"],
        "med": ["split"], "filled": ["split", "med"], "context": ["filled", "machine_v", "inc_h", "maint_h"],
        "base": ["filled"],
    }
    wanted: list[str] = []

    def visit(name: str) -> None:
        for need in needs.get(name, []):
            visit(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        visit(name)
    # Steps read more than once are computed once.
    select = select if select.lstrip().startswith(",") else "\n" + select
    texts = [
        f"{n} AS {'MATERIALIZED ' if n in CHAIN else ''}({(VIEWS[n][1] if n in VIEWS else CHAIN[n]).replace('{TS}', 'TIMESTAMP')})"
        for n in wanted
    ]
    return "WITH " + ",\n".join(texts) + select
