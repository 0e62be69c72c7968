"""Sources, sinks, contracts and preparation operators on small hand-made inputs."""

import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.functions import columns as co
from millwright.functions import quantiles
from millwright.functions.quantiles import exact_quantiles
from millwright.operators import balance as bl
from millwright.operators import clean as cl
from millwright.operators import contracts as ct
from millwright.operators import outliers as ol
from millwright.operators.reports import box_summary
from millwright.functions import storage
from millwright.plans.layers import finish_gold, generate_report, read_sources, run_layers
from millwright.schemas import BRONZE_TELEMETRY, GOLD_COLUMNS, GOLD_IDS, LAYER_TABLES, TYPE_COLUMNS
from millwright.sinks import tables as sk
from millwright.sources import csv_files, layers, sql_dump

DUMP = """BEGIN;
CREATE TABLE machine (machine_code VARCHAR(16) PRIMARY KEY CHECK (machine_code <> ''));
INSERT INTO machine (machine_code, commissioning_date, max_daily_capacity, max_hourly_capacity_pieces, model, production_line, location, criticality)
VALUES
('PRESS-A', '2030-11-20', 640, 40, 'T-9', 'Row 4', 'Shed 1', 'MEDIUM'),
('PRESS-B', 'soon', 912, 57, 'NULL (old), kept', 'Row 4', 'Shed 3', 'LOW')
ON CONFLICT (machine_code) DO UPDATE SET
model = EXCLUDED.model;
INSERT INTO maintenance (maintenance_id, machine_code, maintenance_at, maintenance_type, action_type, component, description, related_incident_id, duration_hours)
VALUES
(1, 'PRESS-A', '2031-02-03 10:00:00+02', 'proactive', 'swap', 'sensor', 'it''s done; (again)', NULL, 3.75),
(2, 'PRESS-A', '2031-02-04 23:30:00+00', 'reactive', 'fix', 'valve', 'x', 'INC-1', 1.5)ON CONFLICT (maintenance_id) DO UPDATE SET
component = EXCLUDED.component;
COMMIT;
"""


@pytest.fixture()
def files(tmp_path):
    lines = ["machine_id,timestamp,temperature_c,pressure_bar,voltage_mean_v,rotation_mean_rpm,pieces_produced"]
    for h in range(40):
        lines.append(f"press-a,2031-02-{3 + h // 24:02d} {h % 24:02d}:10:00,{40 + h % 7},200,220,1500,{h % 4}")
    lines += ["PRESS-A,2031-02-03 00:10:00,99,1,1,1,1", "PRESS-B,not a time,NaN,abc,,inf,2", "PRESS-B,2031-02-03 03:00:00,abc,NaN,,inf,x"]
    (tmp_path / "telemetry.csv").write_text("\n".join(lines) + "\n")
    head = "incident_id,date,time,operator_name,operator_badge,machine_id,severity,comment,shift," + ",".join(TYPE_COLUMNS)
    rows = [head, "INC-1,2031-02-03,05:42,Ann,B1,press-a,3,hot,day," + ",".join("100000000"),
            "INC-2,2031-02-03,05:42:10,Ann,B1,PRESS-A,x,,day," + ",".join(["y"] + list("00000000")),
            "INC-3,2031-02-04,07:00,Bob,B2,PRESS-B,1,cold,night," + ",".join("010000000")]
    (tmp_path / "incidents.csv").write_text("\n".join(rows) + "\n")
    (tmp_path / "dump.sql").write_text(DUMP)
    return tmp_path


def test_layers_from_files_to_gold(spark, files):
    root = str(files / "store")
    sources = read_sources(spark, str(files / "telemetry.csv"), str(files / "incidents.csv"), str(files / "dump.sql"))
    machines = {r["machine_code"]: r for r in sources["machines"].collect()}
    assert machines["PRESS-B"]["model"] == "NULL (old), kept" and machines["PRESS-B"]["commissioning_date"] is None
    kept = sources["maintenance"].orderBy("maintenance_id").collect()
    assert str(kept[0]["maintenance_at"]) == "2031-02-03 08:00:00" and kept[0]["description"] == "it's done; (again)"
    assert kept[0]["related_incident_id"] is None and kept[0]["duration_hours"] == 3.75
    bad = sources["telemetry"].filter("machine_id = 'PRESS-B'").collect()
    assert all(r["temperature_c"] is None and r["pressure_bar"] is None and r["rotation_mean_rpm"] is None for r in bad)

    gold = run_layers(spark, root, sources, csv=True)
    assert sorted(gold.columns) == sorted(GOLD_COLUMNS) and gold.count() == 41
    bronze = layers.read_layer(spark, root, "bronze", "telemetry_raw")
    assert bronze.columns == BRONZE_TELEMETRY and bronze.count() == 43
    first = layers.read_layer(spark, root, "silver", "telemetry").orderBy("machine_id_std", "timestamp").first()
    assert first["temperature_c"] == 40.0  # the first of the two readings, not 99
    incidents = layers.read_layer(spark, root, "silver", "incidents").orderBy("incident_id").collect()
    assert [r["severity"] for r in incidents] == [3, 0, 1] and incidents[1]["type_surchauffe"] == 0
    assert incidents[0]["operator_key"] == incidents[1]["operator_key"] != incidents[2]["operator_key"]

    reloaded = layers.load_gold(spark, root)
    assert reloaded.columns[:4] == GOLD_COLUMNS[:4] and reloaded.columns[-8:] == GOLD_COLUMNS[-8:]
    sk.write_table(sk.pack_gold(layers.load_gold(spark, root)), root, "gold", "packed")
    unpacked = layers.load_gold(spark, root, "packed")
    assert dict(unpacked.dtypes) == dict(gold.dtypes)
    order = ["machine_id_std", "window_start"]
    assert unpacked.select(*GOLD_COLUMNS).orderBy(*order).collect() == gold.select(*GOLD_COLUMNS).orderBy(*order).collect()
    runs = layers.list_runs(spark, root).collect()
    assert [r["layer"] for r in runs if r["layer"] == "gold"] == ["gold"] and len(runs) == 3
    record = next(r for r in runs if r["layer"] == "gold")
    assert record["row_count"] == 41 and sum(record["split_counts"].values()) == 41
    page, total = layers.preview_gold_csv(spark, root, record["run_name"], limit=0, offset=-3)
    assert total == 41 and page.count() == 1
    assert layers.list_gold_csvs(spark, root).count() == 1

    report = generate_report(spark, root, "silver")
    assert len(report) == 17 and report["incidents_per_day"].count() == 2
    assert report["telemetry_duplicates"].head()[0] == 0
    sk.reset_layer(spark, root, "silver", {"machine": sources["machines"].schema})
    assert layers.read_layer(spark, root, "silver", "machine").count() == 0


def test_dump_without_block_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO machine (a) VALUES (1);\n")
    lines = sql_dump.dump_lines(spark, str(tmp_path / "a.sql"))
    assert [r["a"] for r in sql_dump.insert_rows(lines, "machine", ["a"]).collect()] == ["1"]
    assert sql_dump.insert_rows(lines, "absent", ["a"]).count() == 0
    (tmp_path / "b.sql").write_text("-- it's a dump\nINSERT INTO t (a, b) VALUES\n('x\ny',\n 2),\n(NULL\n, 3), ('(\n''z', 4)\n;\nINSERT INTO u (a) VALUES (1);\n")
    wanted = {("x\ny", "2"), (None, "3"), ("(\n'z", "4")}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "16b", "7b"):  # tuples broken over lines and over splits of the file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = sql_dump.dump_lines(spark, str(tmp_path / "b.sql"))
            assert {tuple(r) for r in sql_dump.insert_rows(lines, "t", ["a", "b"]).collect()} == wanted
            assert sql_dump.insert_rows(lines, "u", ["a"]).count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    (tmp_path / "c.sql").write_text("INSERT INTO t (a) VALUES (1), oops, (2);\n")
    with pytest.raises(Exception, match="no tuple in a dump line"):
        sql_dump.insert_rows(sql_dump.dump_lines(spark, str(tmp_path / "c.sql")), "t", ["a"]).collect()


def test_quoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,"said ""stop"", then\nnothing",3\n2,,\n3,"a,b",4\n')
    rows = csv_files.read_text_csv(spark, str(tmp_path / "a.csv"), multiline=True).drop("row_seq").collect()
    assert [tuple(r) for r in rows] == [("1", 'said "stop", then\nnothing', "3"), ("2", None, None), ("3", "a,b", "4")]
    for extra in ("4,x", "4,x,5,6"):
        (tmp_path / "b.csv").write_text(f"id,text,n\n1,a,2\n{extra}\n")
        bad = csv_files.read_text_csv(spark, str(tmp_path / "b.csv"))
        for read in (lambda: bad.collect(), lambda: bad.select("n").collect(), lambda: bad.count()):
            with pytest.raises(Exception, match="wrong number of fields"):
                read()


def test_null_labels_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (None, 0), (3, 1), (4, None), (4, None), (None, None)], "k int, y int")
    assert bl.with_class_weight(df, "y").count() == 7
    assert bl.stratified_split(df, "y", "k", 0.5).count() == 7
    assert [r["n"] for r in bl.downsample(df, "y", "k").groupBy("y").agg(F.count("*").alias("n")).collect()] == [1, 1, 1]
    assert {r["n"] for r in bl.oversample(df, "y", "k").groupBy("y").agg(F.count("*").alias("n")).collect()} == {3}
    many = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") == 0).cast("int").alias("y"))
    copies = bl.oversample(many, "y", "k").filter("y = 1")
    assert copies.count() == copies.select("copy").distinct().count() == 19_999


def test_corrections_keep_every_row(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 6.0), (1, 50.0), (None, 60.0), (2, None)], "k int, x double")
    log = ol.correction_log(ol.correct(df, "x", F.when(F.col("x") > 10, 10.0).otherwise(F.col("x"))), ["k"], "x").collect()
    assert sorted((r["k"] or 0, r["old_value"], r["new_value"]) for r in log) == [(0, 60.0, 10.0), (1, 50.0, 10.0)]


def test_broken_gold_leaves_the_last_one(spark, tmp_path):
    root = str(tmp_path)
    good = spark.createDataFrame([("A", "train"), ("B", "test")], "machine_id_std string, split_set string").withColumns({
        "window_start": F.lit("2031-02-03 00:00:00").cast("timestamp_ntz"), "window_end": F.lit("2031-02-03 01:00:00").cast("timestamp_ntz"),
        **{c: F.lit(1) for c in GOLD_COLUMNS if c not in ("machine_id_std", "split_set", "window_start", "window_end")}}).select(*GOLD_COLUMNS)
    finish_gold(spark, good, root, "files")
    with pytest.raises(ct.ContractError):
        finish_gold(spark, good.unionByName(good), root, "files")
    assert layers.load_gold(spark, root).count() == 2


def test_shared_folder(spark):
    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Other)
    mark = storage.written_so_far(spark)
    kept = storage.materialize(spark.range(5))
    newest = storage.materialize(kept.where("id > 2"))
    assert storage.release(spark, mark, keep_last=1) == 1 and storage.written_so_far(spark) == mark + 1
    assert newest.count() == 2 and storage.release(spark, mark, keep_last=1) == 0
    assert storage.release(spark, mark) == 1 and storage.written_so_far(spark) == mark


def test_contracts(spark):
    df = spark.range(3).withColumn("machine_id_std", F.lit("A"))
    with pytest.raises(ct.ContractError, match="other"):
        ct.require_columns(df, ["id", "other"])
    for layer, persist in (("iron", True), ("silver", False)):
        with pytest.raises(ct.ContractError):
            ct.require_layer(layer, persist=persist)
    with pytest.raises(ct.ContractError):
        layers.layer_path("r", "iron", "t")
    assert layers.list_datasets(spark).count() == sum(map(len, LAYER_TABLES.values()))
    report = ct.expectations(df, unique=[["machine_id_std"]], checks={"small": F.col("id") < 2})
    assert {r["rule"]: r["violations"] for r in report.collect()} == {"unique:machine_id_std": 2, "check:small": 1}
    with pytest.raises(ct.ContractError, match="small"):
        ct.enforce(report)
    gold = df.selectExpr("machine_id_std", "TIMESTAMP_NTZ'2025-01-01 00:00:00' AS window_start", "TIMESTAMP_NTZ'2025-01-01 01:00:00' AS window_end", "'train' AS split_set")
    with pytest.raises(ct.ContractError, match="duplicate"):
        ct.validate_gold(gold)
    assert ct.validate_gold(gold.limit(1))["warnings"]
    missing = gold.limit(1).withColumn("split_set", F.lit(None).cast("string"))
    with pytest.raises(ct.ContractError, match="identifiers"):
        ct.validate_gold(missing)
    with pytest.raises(ct.ContractError, match="1 incidents"):
        ct.require_incident_times(spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS incident_at"))


def test_anonymisation_rules(spark):
    rows = spark.createDataFrame([("1", "B1"), ("2", "B1"), ("3", None)], "incident_id string, operator_badge string")
    with pytest.raises(Exception, match="no operator badge"):
        cl.anonymize_incident_operators(rows).collect()
    keys = [r["operator_key"] for r in cl.anonymize_incident_operators(rows.drop("operator_badge")).collect()]
    assert len(set(keys)) == 3
    known = rows.withColumns({"operator_key": F.lit("OP_x"), "operator_name": F.lit("n")})
    assert cl.anonymize_incident_operators(known).columns == ["incident_id", "operator_key"]


def test_times_and_offsets_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.createDataFrame([("05:42",), ("05:42:10",), ("x",)], "t string")
        assert [r[0] for r in rows.select(co.parse_time(F.col("t"))).collect()] == ["05:42:00", "05:42:10", None]
        hours = spark.sql("SELECT TIMESTAMP_NTZ'2025-03-09 02:30:00' AS t").select(co.floor_hour(F.col("t")).cast("string")).head()[0]
        assert hours == "2025-03-09 02:00:00"
        texts = spark.createDataFrame([("2031-02-03 10:00:00+02", "1"), ("2031-02-03 10:00:00", "1")], "maintenance_at string, duration_hours string")
        assert [str(r["maintenance_at"]) for r in cl.prepare_maintenance(texts).collect()] == ["2031-02-03 08:00:00", "2031-02-03 10:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_outlier_example(spark):
    df = spark.createDataFrame([(float(v),) for v in (7, 8, 6, 9, 61)], "x double")
    flagged = ol.flag_robust_z(ol.flag_iqr(ol.flag_zscore(df, ["x"]), ["x"]), ["x"]).collect()
    assert not any(r["x_is_outlier"] for r in flagged)
    for flag in ("x_is_iqr_outlier", "x_is_robust_outlier"):
        assert [r["x"] for r in flagged if r[flag]] == [61.0]
    flat = ol.flag_robust_z(df.withColumn("x", F.lit(2.0)), ["x"]).collect()
    assert all(r["x_robust_z"] is None and r["x_mad_is_zero"] for r in flat)


@pytest.mark.parametrize("accuracy", [4, 50, 50_000])
def test_exact_quantiles_with_coarse_sketches_and_ties(spark, accuracy):
    rows = [(i % 3, float(v)) for i, v in enumerate([5] * 300 + list(range(100)) + [1e9, -1e9])]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for by in ([], ["g"]):
        want = df.groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q"))
        got = exact_quantiles(df, ["x"], probs, by, accuracy)
        a = sorted([tuple(r[k] for k in by) + tuple(r["q"]) for r in want.collect()])
        b = sorted([tuple(r[k] for k in by) + tuple(r[f"x_q{i}"] for i in range(len(probs))) for r in got.collect()])
        assert len(a) == len(b) and all(math.isclose(u, v) for x, y in zip(a, b) for u, v in zip(x, y))


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 20 == 0).cast("int"))
    down = bl.downsample(df, "y", "id")
    assert {r["y"]: r["count"] for r in down.groupBy("y").count().collect()} == {0: 50, 1: 50}
    assert sorted(down.collect()) == sorted(bl.downsample(df.repartition(7), "y", "id").collect())
    up = bl.oversample(df, "y", "id")
    assert {r["y"]: r["count"] for r in up.groupBy("y").count().collect()} == {0: 950, 1: 950}
    parts = bl.stratified_split(df, "y", "id").groupBy("y", "part").count().collect()
    assert {(r["y"], r["part"]): r["count"] for r in parts} == {(0, "test"): 190, (0, "train"): 760, (1, "test"): 10, (1, "train"): 40}


def test_ranking_metrics_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.5), (1, 0.8)]
    pairs = [(s, t) for y, s in rows if y for z, t in rows if not z]
    auc = sum((s > t) + 0.5 * (s == t) for s, t in pairs) / len(pairs)
    got = bl.ranking_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s", pieces=3).head()
    assert math.isclose(got["roc_auc"], auc)


def test_upsert_keeps_the_last_incoming_row(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, n int")
    assert sorted(map(tuple, sk.upsert(old, new, ["k"], "n").collect())) == [(1, "a"), (2, "y"), (3, "z")]


def test_quantiles_of_few_groups_leave_their_rows_in_place(spark):
    rows = spark.createDataFrame([(("a", "b")[k % 7 == 0], float(k * k % 1009)) for k in range(5000)], "g string, x double")
    found = exact_quantiles(rows, ["x"], [0.25, 0.5], ["g"])
    want = rows.groupBy("g").agg(*(F.expr(f"percentile(x, {p})") for p in (0.25, 0.5)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__x_ends" in plan and not any("__salt" in line for line in plan.splitlines() if "Join" in line)


def test_box_summary_of_many_groups_broadcasts_no_copies(spark, monkeypatch):
    """A group's copies for all salts are many times what Spark's guess from the stored file says."""
    rows = spark.range(600).selectExpr("id % 30 AS machine_id", "CAST(id * id % 97 AS DOUBLE) AS v", "id")
    few = box_summary(rows, ["v"], "machine_id").collect()
    monkeypatch.setattr(quantiles, "BROADCAST_GROUPS", 5)
    many = box_summary(rows, ["v"], "machine_id")
    joins = [line for line in many._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "__salt" in line]
    assert joins and not any("Broadcast" in line for line in joins)
    assert sorted(many.collect()) == sorted(few) and len(few) == 30
    values = np.array([k * k % 97 for k in range(600) if k % 30 == 7])
    got = next(r for r in few if r.machine_id == 7)
    assert np.allclose((got.q1, got["median"], got.q3), np.quantile(values, [0.25, 0.5, 0.75]))


def test_stored_gold_packs_numbers_without_dictionaries(spark, tmp_path):
    """Numbers that differ from row to row, but repeat over neighbouring rows as rolling maxima do."""
    rows = spark.range(40_000).selectExpr("'M' AS machine_id_std", "'train' AS split_set", "sqrt(id) AS x", "sqrt(id DIV 12) AS most", "sqrt(id DIV 6) AS more")
    path, plain = sk.write_gold(rows.coalesce(1), str(tmp_path)), str(tmp_path / "plain")
    rows.coalesce(1).write.partitionBy("split_set").parquet(plain)
    size = lambda top: sum(f.stat().st_size for f in pathlib.Path(top).rglob("*.parquet"))
    assert size(path) < 0.85 * size(plain)
    assert spark.read.parquet(path).exceptAll(spark.read.parquet(plain)).isEmpty()


def test_packed_keys_are_looked_at_one_by_one_only_where_they_differ(spark):
    schemas = tuple(spark.range(0).selectExpr(f"id AS {a}", f"id AS {b}").schema for a, b in ("xy", "vw"))
    ids = {c: "CAST(NULL AS STRING)" for c in GOLD_IDS}

    def unpacked(features):
        row = spark.range(1).selectExpr(*(f"{v} AS {c}" for c, v in ids.items()), f"{features} AS features", "'{\"v\":1,\"w\":2}' AS labels")
        return sk.unpack_gold(row, schemas)

    for text, want in (('{"x":1,"y":2}', (1, 2, 1, 2)), ('{"y":2,"x":1}', (1, 2, 1, 2)), ('{"x":1}', (1, None, 1, 2))):
        assert tuple(unpacked(f"'{text}'").first())[len(GOLD_IDS):] == want
    assert tuple(unpacked("CAST(NULL AS STRING)").first())[len(GOLD_IDS):] == (None, None, 1, 2)
    for text in ('{"x":1,"z":2}', '{"x":1,"y":2,"z":3}'):
        with pytest.raises(Exception, match="other columns: z"):
            unpacked(f"'{text}'").collect()
    packed = spark.createDataFrame([], ", ".join(f"{c} string" for c in [*GOLD_IDS, "features", "labels"]))
    assert "NOT (json_object_keys(features" in sk.unpack_gold(packed, schemas)._jdf.queryExecution().analyzed().toString()
