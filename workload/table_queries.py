"""Column rules, sources and sinks over data that Spark derives from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millwright.functions import columns as co
from millwright.functions.storage import release, shared_dir, written_so_far
from millwright.operators import clean as cl
from millwright.operators import contracts as ct
from millwright.operators import states
from millwright.operators.asof import hours_since_last_event_asof
from millwright.plans.layers import finish_gold, generate_report, run_layers
from millwright.schemas import GOLD_LABELS, MACHINE_COLUMNS, TYPE_COLUMNS
from millwright.sinks import keyed
from millwright.sinks import tables as sk
from millwright.sources import csv_files, layers, sql_dump
from workload.gold_queries import _gold, _hourly, _silver
from workload.registry import query, r, rounded
from workload.views import table, view, with_views


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scratch(spark, name):
    return f"{shared_dir(spark)}/millwright/{name}-{uuid.uuid4().hex}"


# ---- column rules

MESSY = "CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN 'NaN' WHEN event_id % 7 = 3 THEN concat(' ', CAST(value AS {S}), ' ') ELSE CAST(value AS {S}) END"


@query(f"SELECT event_id, {r('CASE WHEN event_id % 7 > 2 OR event_id % 7 < 0 THEN value END', 'number')}, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS stamp FROM events")
def lenient_typing(spark, sf):
    e = table(spark, sf, "events")
    stamp = F.when(F.col("event_id") % 3 == 0, "2024-13-45 99:00").otherwise(F.col("ts").cast("string"))
    text = F.expr(MESSY.replace("{S}", "STRING"))
    return rounded(e.select("event_id", co.to_double(text).alias("number"), co.to_timestamp(stamp).alias("stamp")))


@query(with_views("SELECT row_seq, upper(trim(machine_id)) AS machine_id_std, date_trunc('hour', timestamp) AS window_start, "
                  "date_trunc('hour', timestamp) + INTERVAL 1 HOUR AS window_end FROM telemetry_v", "telemetry_v"))
def standard_keys(spark, sf):
    t = view(spark, sf, "telemetry_v")
    start = co.floor_hour(F.col("timestamp"))
    return t.select("row_seq", co.standard_id(F.col("machine_id")).alias("machine_id_std"), start.alias("window_start"),
                    (start + F.expr("INTERVAL '1' HOUR")).alias("window_end"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M:00') END AS time,
 CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS incident_at FROM events""")
def date_time_parsing(spark, sf):
    e = table(spark, sf, "events")
    text = F.when(F.col("event_id") % 3 == 2, "x").when(F.col("event_id") % 3 == 1, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm"))
    time = co.parse_time(text)
    return e.select("event_id", time.alias("time"), co.combine_date_time(F.col("ts").cast("date"), time).alias("incident_at"))


@query("SELECT event_id, date_trunc('second', ts) - INTERVAL 2 HOUR * (event_id % 2) AS maintenance_at, date_trunc('hour', date_trunc('second', ts) - INTERVAL 2 HOUR * (event_id % 2)) AS maintenance_hour FROM events")
def offset_times_to_utc(spark, sf):
    e = table(spark, sf, "events")
    zone = F.when(F.col("event_id") % 2 == 0, "+00").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), zone)
    rows = e.select("event_id", text.alias("maintenance_at"), F.lit("1.5").alias("duration_hours"))
    return cl.prepare_maintenance(rows).select("event_id", "maintenance_at", "maintenance_hour")


@query(with_views(f"SELECT row_seq, {r('CASE WHEN temperature_c > 80 THEN (temperature_c - 32.0E0) * 5.0E0 / 9.0E0 ELSE temperature_c END', 'temperature_c')} FROM telemetry_v", "telemetry_v"))
def fahrenheit_repair(spark, sf):
    return rounded(view(spark, sf, "telemetry_v").select("row_seq", co.celsius(F.col("temperature_c")).alias("temperature_c")))


@query("SELECT l_orderkey, l_linenumber, " + r("CASE WHEN l_linenumber > 2 THEN 100 * l_quantity / (l_linenumber - 2) ELSE 0 END", "pct")
       + ", " + r("coalesce(l_quantity / nullif(l_linenumber - 3, 0), 0)", "ratio") + " FROM lineitem")
def guarded_ratios(spark, sf):
    line = table(spark, sf, "lineitem")
    capacity = (F.col("l_linenumber") - 2).cast("double")
    ratio = F.coalesce(co.finite(F.try_divide(F.col("l_quantity"), (F.col("l_linenumber") - 3).cast("double"))), F.lit(0.0))
    return rounded(line.select("l_orderkey", "l_linenumber", co.utilization_pct(F.col("l_quantity"), capacity).alias("pct"), ratio.alias("ratio")))


@query(with_views("SELECT count(*) AS incidents, count(DISTINCT operator_badge) AS operators, count(DISTINCT operator_badge) AS pairs, 0 AS identity_columns, true AS well_formed FROM incidents_v", "incidents_v"))
def operator_anonymisation(spark, sf):
    raw = view(spark, sf, "incidents_v").withColumn("operator_name", F.lit("someone"))
    keys = cl.anonymize_incident_operators(raw)
    left = len({"operator_badge", "operator_name"} & set(keys.columns))
    joined = keys.select("incident_id", "operator_key").join(raw.select("incident_id", "operator_badge"), "incident_id")
    return joined.agg(
        F.count(F.lit(1)).alias("incidents"), F.count_distinct("operator_key").alias("operators"),
        F.count_distinct("operator_key", "operator_badge").alias("pairs"), F.lit(left).alias("identity_columns"),
        F.bool_and(F.col("operator_key").rlike("^OP_[0-9a-f]{61}$")).alias("well_formed"),
    )


ASOF = """SELECT t.row_seq, e.at AS last_event_at, CAST(round((epoch_us(t.timestamp) - epoch_us(e.at)) / 3600000000.0E0 + 1.7E-8, 6) AS DOUBLE) + 0.0E0 AS hours_since
FROM (SELECT row_seq, upper(trim(machine_id)) AS m, timestamp FROM telemetry_v) t
ASOF LEFT JOIN (SELECT DISTINCT machine_id_std AS m, incident_at AS at FROM incidents_v) e ON t.m = e.m AND t.timestamp >= e.at"""


@query(with_views(ASOF, "telemetry_v", "incidents_v"))
def backward_asof_join(spark, sf):
    probes = view(spark, sf, "telemetry_v").select("row_seq", co.standard_id(F.col("machine_id")).alias("machine_id_std"), "timestamp")
    events = view(spark, sf, "incidents_v").select("machine_id_std", F.col("incident_at").alias("timestamp"))
    found = hours_since_last_event_asof(probes, events, "machine_id_std", "timestamp")
    return rounded(found.select("row_seq", "last_event_at", "hours_since"))


# ---- sources and sinks

@query(with_views(f"SELECT machine_id, timestamp, {r('temperature_c')}, {r('pressure_bar')}, {r('voltage_mean_v')}, {r('rotation_mean_rpm')}, pieces_produced FROM telemetry_v", "telemetry_v"))
def csv_telemetry_source(spark, sf):
    path = _scratch(spark, "telemetry-csv")
    rows = view(spark, sf, "telemetry_v").drop("row_seq")
    rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return rounded(csv_files.load_telemetry(spark, path).drop("row_seq"))


NOTE = "concat('dit \"stop\", puis ', {C}, chr(10), 'rien')"


@query(with_views(
    f"SELECT incident_id, CAST(incident_at AS DATE) AS date, strftime(incident_at, '%H:%M:%S') AS time, machine_id, severity, "
    f"CASE WHEN comment IS NULL OR comment = '' THEN NULL ELSE {NOTE.format(C='comment')} END AS comment, shift, {', '.join(TYPE_COLUMNS)}, "
    "date_trunc('second', incident_at) AS incident_at, window_start, machine_id_std, "
    "concat('OP_', substr(sha256(concat('pinch', operator_badge)), 1, 61)) AS operator_key FROM incidents_v", "incidents_v"))
def csv_incident_source(spark, sf):
    """Every column, with comments that hold quotes, commas and line breaks."""
    path = _scratch(spark, "incidents-csv")
    rows = view(spark, sf, "incidents_v").withColumns({
        "date": F.date_format("incident_at", "yyyy-MM-dd"), "time": F.date_format("incident_at", "HH:mm:ss"),
        "operator_name": F.lit('Ann "A", of hall 2'), "comment": F.when(F.col("comment") != "", F.expr(NOTE.format(C="comment"))),
    })
    rows.drop("incident_at", "window_start", "machine_id_std").write.options(header=True, escape='"').csv(path)
    return csv_files.load_incidents(spark, path, salt="pinch").select(
        "incident_id", "date", "time", "machine_id", "severity", "comment", "shift", *TYPE_COLUMNS, "incident_at", "window_start",
        "machine_id_std", "operator_key")


def _dump(df, table, key, broken):
    """Dump text of a frame: two copies of every tuple, broken over lines."""
    def literal(name, kind):
        c = F.col(name)
        text = c.cast("string") if kind in ("int", "bigint", "double") else F.concat(F.lit("'"), F.regexp_replace(c.cast("string"), "'", "''"), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    values = F.concat_ws(f",{broken} ", *[literal(n, k) for n, k in df.dtypes])
    return df.select(F.concat(
        F.lit(f"INSERT INTO {table} ({', '.join(df.columns)})\nVALUES\n("), values, F.lit("),\n("), values,
        F.lit(f")\nON CONFLICT ({key}) DO UPDATE SET\n{key} = EXCLUDED.{key};\nINSERT INTO other (a, b) VALUES (1, 'x');\n-- it's done"),
    ).alias("value"))


@query(with_views(f"SELECT {', '.join(MACHINE_COLUMNS)}, concat('it''s (', model, '), a ''test''', chr(10), 'or (two') AS note FROM machine_v", "machine_v"))
def sql_dump_source(spark, sf):
    """Machines written as dump text, tuples and texts broken over lines, and read back over small splits."""
    path = _scratch(spark, "dump")
    note = F.concat(F.lit("it's ("), "model", F.lit("), a 'test'\nor (two"))
    _dump(view(spark, sf, "machine_v").withColumn("note", note), "machine", "machine_code", "\n").write.text(path)
    rows = sql_dump.insert_rows(sql_dump.dump_lines(spark, path), "machine", [*MACHINE_COLUMNS, "note"])
    return sql_dump.typed_machines(rows).dropDuplicates()


@query(with_views("SELECT machine_code, concat('it''s \\ (', model, '), a ''test''', chr(10), 'or (two') AS escaped, "
                  "concat('it''s \\ (', model, '), a ''test''', chr(10), 'or (two') AS dollars FROM machine_v", "machine_v"))
def sql_dump_quotes(spark, sf):
    """Texts as escape strings and dollar quotes, broken over lines, read back from dump text."""
    path = _scratch(spark, "dump")
    note = F.concat(F.lit("it's \\ ("), "model", F.lit("), a 'test'\nor (two"))
    escaped = F.replace(F.replace(note, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    values = F.concat(F.lit("('"), "machine_code", F.lit("', E'"), escaped, F.lit("',\n$note$"), note, F.lit("$note$)"))
    dump = F.concat(F.lit("INSERT INTO machine (machine_code, escaped, dollars) VALUES\n"), values, F.lit(";\n-- it's E'done $note$"))
    view(spark, sf, "machine_v").select(dump.alias("value")).write.text(path)
    return sql_dump.insert_rows(sql_dump.dump_lines(spark, path), "machine", ["machine_code", "escaped", "dollars"])


@query(with_views(f"SELECT maintenance_id, machine_code, date_trunc('second', maintenance_at) AS maintenance_at, maintenance_type, component, "
                  f"{r('duration_hours')}, maintenance_hour FROM maintenance_v", "maintenance_v"))
def sql_dump_maintenance(spark, sf):
    path = _scratch(spark, "dump")
    columns = ["maintenance_id", "machine_code", "maintenance_at", "maintenance_type", "component", "duration_hours"]
    at = F.concat(F.date_format("maintenance_at", "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))
    _dump(view(spark, sf, "maintenance_v").select(*columns).withColumn("maintenance_at", at), "maintenance", "maintenance_id", "").write.text(path)
    rows = sql_dump.insert_rows(sql_dump.dump_lines(spark, path), "maintenance", columns)
    done = sql_dump.typed_maintenance(rows).dropDuplicates().withColumn("maintenance_id", F.col("maintenance_id").cast("long"))
    return rounded(done.select(*columns, "maintenance_hour"))


@query(with_views(f"SELECT machine_id_std, window_start, {r('temp_mean_1h')}, {r('pieces_produced_1h')} FROM hourly", "hourly"))
def layer_table_round_trip(spark, sf):
    root = _scratch(spark, "layers")
    sk.write_table(_hourly(spark, sf), root, "silver", "telemetry", ["machine_id_std", "window_start", "temp_mean_1h", "pieces_produced_1h"])
    return rounded(layers.read_layer(spark, root, "silver", "telemetry"))


@query(with_views("SELECT machine_id_std, window_start, timestamp, machine_id FROM silver_t ORDER BY machine_id_std, timestamp LIMIT 500 OFFSET 100", "silver_t"))
def table_preview_page(spark, sf):
    rows = _silver(spark, sf).select("machine_id_std", "window_start", "timestamp", "machine_id")
    return layers.page(rows, ["machine_id_std", "timestamp"], limit=5000, offset=100)


def _pack_sql():
    from workload.gold_queries import GOLD_SQL
    return GOLD_SQL


@query(_pack_sql())
def gold_json_round_trip(spark, sf):
    gold = _gold(spark, sf)
    packed = sk.pack_gold(gold)
    return rounded(sk.unpack_gold(packed, sk.gold_json_schemas(gold)))


@query(_pack_sql())
def gold_table_reload(spark, sf):
    """Written, validated and published as a run, then read back in full."""
    root = _scratch(spark, "gold")
    mark = written_so_far(spark)
    finish_gold(spark, _gold(spark, sf), root, "files")
    release(spark, mark)
    stored = layers.load_gold(spark, root)
    assert stored.columns[-len(GOLD_LABELS):] == GOLD_LABELS
    return rounded(stored)


@query(f"""SELECT o_orderkey, {r('o_totalprice')}, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey, {r('o_totalprice + 1', 'o_totalprice')}, 'U' FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT -o_orderkey, {r('o_totalprice + 1', 'o_totalprice')}, 'U' FROM orders WHERE o_orderkey % 10 = 1""")
def keyed_upsert(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    changed = orders.filter(k % 10 < 2).select(
        F.when(k % 10 == 0, k).otherwise(-k).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"))
    return rounded(sk.upsert(orders, changed, ["o_orderkey"]))


@query("""WITH old AS (SELECT CAST(c_custkey AS VARCHAR) AS run_ts, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS run_name, c_nationkey AS n FROM customer),
new AS (SELECT run_ts, run_name, n + 100 AS n FROM old WHERE n < 5)
SELECT run_ts, run_name, CAST(NULL AS VARCHAR) AS run_id, n FROM old o WHERE NOT EXISTS (SELECT 1 FROM new w WHERE coalesce(w.run_name, w.run_ts) = coalesce(o.run_name, o.run_ts))
UNION ALL SELECT run_ts, run_name, NULL, n FROM new""")
def run_index_merge(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.col("c_custkey").cast("string").alias("run_ts"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("run_name"),
                   F.lit(None).cast("string").alias("run_id"), F.col("c_nationkey").alias("n"))
    return sk.merge_run_index(old, old.filter("n < 5").withColumn("n", F.col("n") + 100))


# ---- gold totals, exports, run index, stored reports

@query(with_views("SELECT CAST(sum(incident_count_1h) AS BIGINT) AS incidents_attached, CAST(sum(maintenance_count_1h) AS BIGINT) AS maintenances_attached FROM context", "context"))
def gold_attached_totals(spark, sf):
    return ct.attached_totals(_gold(spark, sf))


EXPORTED = ["machine_id_std", "split_set", "incident_count_1h", "maintenance_count_1h"]


@query(with_views(f"SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS window_start, machine_id_std, split_set, CAST(CAST(incident_count_1h AS BIGINT) AS VARCHAR) AS incident_count_1h, "
                  "CAST(CAST(maintenance_count_1h AS BIGINT) AS VARCHAR) AS maintenance_count_1h FROM context", "context"))
def gold_csv_export(spark, sf):
    """The sorted CSV copy of gold, read back as text in full."""
    root = _scratch(spark, "export")
    gold = _gold(spark, sf).select("window_start", *EXPORTED)
    whole = {c: F.col(c).cast("long") for c in EXPORTED[2:]}
    path = sk.export_gold_csv(layers.text_cells(gold.withColumns(whole)), root, "run")
    return spark.read.options(header=True, escape='"').csv(path).select("window_start", *EXPORTED)


@query(with_views("SELECT strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS window_start, machine_id_std FROM context ORDER BY machine_id_std, window_start LIMIT 40 OFFSET 25", "context"))
def gold_csv_preview(spark, sf):
    """A page of the CSV copy, found through the run index."""
    root = _scratch(spark, "preview")
    gold = layers.text_cells(_gold(spark, sf).select("machine_id_std", "window_start"))
    sk.export_gold_csv(gold, root, "run-a")
    stamp = spark.range(1).select(F.lit("20310203").alias("run_ts"), F.lit("run-a").alias("run_name"), F.lit("gold").alias("layer"))
    sk.append_run(stamp, root)
    run = layers.list_gold_csvs(spark, root).first()
    return layers.preview_gold_csv(spark, root, run["run_name"], limit=40, offset=25)[0].select("window_start", "machine_id_std")


@query(with_views("SELECT 'gold' AS layer, count(*) AS row_count, count(DISTINCT machine_id_std) AS machines, "
                  "count(*) FILTER (split_set = 'train') AS train, count(*) FILTER (split_set = 'validation') AS validation, "
                  "count(*) FILTER (split_set = 'test') AS test, 113 AS column_count FROM split", "split"))
def gold_record_from_the_write(spark, sf):
    """The run record of a gold table, counted by the tasks that write it."""
    root = _scratch(spark, "gold")
    mark = written_so_far(spark)
    finish_gold(spark, _gold(spark, sf), root, "files")
    release(spark, mark)
    splits = [F.col("split_counts")[s].alias(s) for s in ("train", "validation", "test")]
    return sk.list_runs(spark, root).select("layer", "row_count", "machines", *splits, "column_count")


@query("""SELECT concat('| ', c_name, ' | ', 'silver | bronze | ', CAST(c_nationkey AS VARCHAR), ' |  | ', '/runs/', CAST(c_custkey AS VARCHAR), ' |') AS line FROM customer""")
def run_index_as_lines(spark, sf):
    """The run index as table lines; an unknown count stays blank."""
    root = _scratch(spark, "runs")
    c = table(spark, sf, "customer")
    sk.append_run(c.select(
        F.col("c_name").alias("run_name"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("run_ts"), F.lit("silver").alias("layer"),
        F.lit("bronze").alias("source_layer"), F.col("c_nationkey").alias("row_count"), F.concat(F.lit("/runs/"), "c_custkey").alias("run_dir")), root)
    return sk.run_index_lines(sk.list_runs(spark, root))


@query(with_views("SELECT 'telemetry' AS source, count(*) AS rows, count(DISTINCT machine_id) AS machines, count(*) FILTER (timestamp IS NULL) AS invalid_timestamps FROM telemetry_v "
                  "UNION ALL SELECT 'incidents', count(*), count(DISTINCT machine_id), count(*) FILTER (incident_at IS NULL) FROM incidents_v", "telemetry_v", "incidents_v"))
def loaded_source_summary(spark, sf):
    """Rows, machines and unreadable times of both sources."""
    parts = [csv_files.source_summary(view(spark, sf, v), time).select(F.lit(name).alias("source"), "*")
             for name, v, time in (("telemetry", "telemetry_v", "timestamp"), ("incidents", "incidents_v", "incident_at"))]
    return parts[0].unionByName(parts[1])


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS run_ts, c_name AS run_name, CAST(c_nationkey AS BIGINT) AS row_count FROM customer ORDER BY run_ts DESC LIMIT 50")
def run_index_newest_first(spark, sf):
    root = _scratch(spark, "runs")
    c = table(spark, sf, "customer")
    record = c.select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("run_ts"), F.col("c_name").alias("run_name"),
                      F.col("c_nationkey").cast("long").alias("row_count"))
    sk.append_run(record.withColumn("row_count", F.lit(-1).cast("long")), root)
    sk.append_run(record, root)
    return sk.list_runs(spark, root).select("run_ts", "run_name", F.col("row_count").cast("long").alias("row_count")).limit(50)


@query("SELECT 0 AS rows_left, count(*) AS rows_before, 9 AS columns_left FROM lineitem")
def layer_reset(spark, sf):
    root = _scratch(spark, "reset")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    sk.write_table(rows, root, "silver", "telemetry")
    before = layers.read_layer(spark, root, "silver", "telemetry").count()
    sk.reset_layer(spark, root, "silver", {"telemetry": rows.schema})
    left = layers.read_layer(spark, root, "silver", "telemetry")
    return left.agg(F.count(F.lit(1)).cast("int").alias("rows_left")).select(
        "rows_left", F.lit(before).cast("long").alias("rows_before"), F.lit(len(left.columns)).alias("columns_left"))


@query(with_views("""SELECT 'incidents_per_day' AS report, count(*) AS n FROM (SELECT DISTINCT CAST(incident_at AS DATE) FROM incidents_v)
UNION ALL SELECT 'machines_per_criticality', count(DISTINCT criticality) FROM machine_v
UNION ALL SELECT 'machine_component', count(DISTINCT machine_code) FROM maintenance_v
UNION ALL SELECT 'telemetry_duplicates', 1""", "incidents_v", "machine_v", "maintenance_v"))
def stored_layer_report(spark, sf):
    """Bronze and silver built from the views, then the report of the stored layer."""
    root = _scratch(spark, "report")
    incidents = view(spark, sf, "incidents_v").withColumns({"date": F.date_format("incident_at", "yyyy-MM-dd"), "time": F.date_format("incident_at", "HH:mm:ss")})
    sources = {
        "telemetry": view(spark, sf, "telemetry_v"), "machines": view(spark, sf, "machine_v"), "maintenance": view(spark, sf, "maintenance_v").drop("maintenance_hour"),
        "incidents": cl.anonymize_incident_operators(incidents.drop("incident_at", "window_start", "machine_id_std")),
    }
    run_layers(spark, root, sources, "bronze")
    run_layers(spark, root, sources, "silver")
    tables = generate_report(spark, root, "silver")
    parts = [tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n")
             for name in ("incidents_per_day", "machines_per_criticality", "machine_component", "telemetry_duplicates")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT strftime(ts, '%Y-%m') AS month, CAST(count(DISTINCT user_id) AS BIGINT) AS n_exact, TRUE AS within_error FROM events GROUP BY 1")
def distinct_counts_from_states(spark, sf):
    """Machines seen per month, from states per day; right to four standard errors."""
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    root = _scratch(spark, "states")
    states.distinct_states(events, ["day"], "user_id").write.mode("overwrite").parquet(root)
    month = F.date_format("day", "yyyy-MM").alias("month")
    found = states.merged_distinct(spark.read.parquet(root).withColumn("month", month), ["month"])
    exact = events.groupBy(month).agg(F.countDistinct("user_id").alias("n_exact"))
    error = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * 1.04 / 2 ** (states.HLL_BITS / 2) * F.col("n_exact") + 1
    return exact.join(found, "month").select("month", "n_exact", error.alias("within_error"))


@query(f"SELECT signal, CAST(count(v) AS BIGINT) AS n, unnest([0.05E0, 0.25E0, 0.5E0, 0.75E0, 0.95E0]) AS share, TRUE AS within_error "
       f"FROM (UNPIVOT (SELECT {', '.join(LINE_NUMBERS)} FROM lineitem) ON {', '.join(LINE_NUMBERS)} INTO NAME signal VALUE v) GROUP BY 1")
def quantiles_from_states(spark, sf):
    """Quantiles of a whole table from states per day; the value's rank is right to the state's rank error."""
    lines = table(spark, sf, "lineitem")
    root, shares = _scratch(spark, "states"), [0.05, 0.25, 0.5, 0.75, 0.95]
    states.quantile_states(lines, ["l_shipdate"], LINE_NUMBERS).write.mode("overwrite").parquet(root)
    found = states.merged_quantiles(spark.read.parquet(root), [], shares)
    found = found.select("signal", "n", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("quantiles").alias("value"))).alias("x"))
    found = found.select("signal", "n", "x.*")
    wanted = {(x["signal"], x["share"]): x["value"] for x in found.collect()}  # five rows a signal
    below = [F.struct(F.lit(c).alias("c"), F.lit(s).alias("s"), F.avg((F.col(c) < v).cast("int")).alias("low"), F.avg((F.col(c) <= v).cast("int")).alias("high"))
             for (c, s), v in wanted.items()]
    ranks = lines.agg(F.array(*below).alias("all")).select(F.explode("all").alias("x")).select("x.*")
    error = (F.col("low") - states.RANK_ERROR <= F.col("share")) & (F.col("high") + states.RANK_ERROR >= F.col("share"))
    return found.join(ranks, (F.col("signal") == F.col("c")) & (F.col("share") == F.col("s"))).select("signal", "n", "share", error.alias("within_error"))


@query(f"""SELECT o_orderkey, {r('o_totalprice')}, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT o_orderkey, {r('o_totalprice + 1', 'o_totalprice')}, 'U' FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT -o_orderkey, {r('o_totalprice + 1', 'o_totalprice')}, 'U' FROM orders WHERE o_orderkey % 10 = 1""")
def keyed_upsert_in_buckets(spark, sf):
    """The same upsert on a table in buckets, where the keys of a tenth of the customers change."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path, k = _scratch(spark, "keyed"), F.col("o_orderkey")
    keyed.write_keyed(orders, path, ["o_orderkey"], 32)
    changed = orders.filter(k % 10 < 2).select(
        F.when(k % 10 == 0, k).otherwise(-k).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"))
    keyed.upsert_keyed(spark, path, changed, ["o_orderkey"], 32)
    return rounded(keyed.read_keyed(spark, path))


@query("SELECT l_orderkey, l_linenumber, " + r("l_quantity") + " FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 500 OFFSET 47000")
def stored_table_page(spark, sf):
    """A page deep inside a table that is stored for paging."""
    path, order = _scratch(spark, "pages"), ["l_orderkey", "l_linenumber"]
    layers.write_pages(table(spark, sf, "lineitem").select(*order, "l_quantity"), order, path, part_rows=5000)
    return rounded(layers.stored_page(spark, path, order, limit=900, offset=47_000))


@query(with_views("SELECT 'silver' AS layer, 'telemetry' AS \"table\", count(*) AS rows FROM hourly UNION ALL SELECT 'bronze', 'machine', count(*) FROM machine_v", "hourly", "machine_v"))
def layer_catalogue(spark, sf):
    """The catalogue's tables that are stored, with their rows."""
    root = _scratch(spark, "layers")
    sk.write_table(_hourly(spark, sf), root, "silver", "telemetry")
    sk.write_table(view(spark, sf, "machine_v"), root, "bronze", "machine")
    return layers.stored_tables(spark, root).where("rows IS NOT NULL")


@query(with_views("SELECT * FROM (SELECT 'temperature_c' AS \"column\", TRUE AS present, count(*) - count(temperature_c) AS violations FROM telemetry_v "
                  "UNION ALL SELECT 'voltage_mean_v', TRUE, count(*) - count(voltage_mean_v) FROM telemetry_v UNION ALL SELECT 'humidity', FALSE, count(*) FROM telemetry_v)", "telemetry_v"))
def required_columns(spark, sf):
    return ct.column_contract(view(spark, sf, "telemetry_v"), ["temperature_c", "voltage_mean_v", "humidity"])


@query(with_views("SELECT incident_id FROM incidents_v WHERE CAST(regexp_extract(incident_id, '[0-9]+') AS BIGINT) % 7 = 0", "incidents_v"))
def incidents_without_time(spark, sf):
    number = F.regexp_extract("incident_id", "[0-9]+", 0).cast("long")
    rows = view(spark, sf, "incidents_v").select("incident_id", F.to_date("incident_at").alias("date"), F.when(number % 7 == 0, "25:99").otherwise(F.date_format("incident_at", "HH:mm:ss")).alias("time"))
    timed = layers.with_incident_time(rows)
    return ct.incident_time_violations(timed).select("incident_id")
