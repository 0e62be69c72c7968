"""Hand-made cases for the machine-hour spine and the feature families."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwright.functions import storage
from millwright.operators import features as ft
from millwright.operators import hourly as hr
from millwright.operators import impute as im
from millwright.operators.clean import build_silver_telemetry
from millwright.plans.gold import build_gold
from millwright.schemas import GOLD_COLUMNS, SIGNALS, TYPE_COLUMNS

T0 = datetime(2025, 6, 1)
TELEMETRY = (
    "row_seq long, machine_id string, timestamp timestamp_ntz, temperature_c double, pressure_bar double, "
    "voltage_mean_v double, rotation_mean_rpm double, pieces_produced int"
)
INCIDENTS = "incident_id string, machine_id_std string, window_start timestamp_ntz, severity int, " + ", ".join(
    f"{c} int" for c in TYPE_COLUMNS
)
MAINTENANCE = "maintenance_id int, machine_code string, maintenance_hour timestamp_ntz"
MACHINES = (
    "machine_code string, commissioning_date date, max_daily_capacity int, max_hourly_capacity_pieces int, "
    "model string, production_line string, location string, criticality string"
)


def hour(n):
    return T0 + timedelta(hours=n)


def reading(seq, machine, h, temp, pieces=1):
    return (seq, machine, hour(h), temp, 200.0, 220.0, 1500.0, pieces)


def telemetry(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY)


def history(machine, values, start=0, first=0):
    """A complete series; None leaves the hour out."""
    return [reading(first + i, machine, start + i, v) for i, v in enumerate(values) if v is not None]


def test_keep_first_repairs_units_and_drops_missing_times(spark):
    rows = [
        reading(2, "MACH-01", 0, 46.33), reading(1, " mach-01 ", 0, 46.35), reading(3, "MACH-01", 1, 80.0),
        reading(4, "MACH-01", 2, 80.1), (5, "MACH-01", None, 50.0, 1.0, 1.0, 1.0, 1),
    ]
    out = build_silver_telemetry(telemetry(spark, rows)).orderBy("timestamp").collect()
    assert [round(r["temperature_c"], 2) for r in out] == [46.35, 80.0, 26.72]
    assert {r["machine_id_std"] for r in out} == {"MACH-01"}


def test_observed_hour_without_pieces_is_zero_and_null_machines_leave(spark):
    rows = [reading(1, "A", 0, 1.0, None), reading(2, "A", 2, 1.0, 5), reading(3, None, 0, 1.0)]
    hourly = hr.aggregate_hourly(build_silver_telemetry(telemetry(spark, rows)))
    grid = hr.add_temporal_split(hr.complete_hourly_grid(hourly))
    filled = im.impute_hourly_signals(grid).orderBy("window_start").collect()
    assert [r["pieces_produced_1h"] for r in filled] == [0.0, 2.5, 5.0]


def test_gaps_at_both_ends_single_value_and_empty_machine(spark):
    rows = [(m, hour(h), "train", v) for m, vs in {
        "gaps": [None, 1.0, None, 3.0, None], "one": [None, 7.0, None, None, None], "none": [None] * 5}.items() for h, v in enumerate(vs)]
    grid = spark.createDataFrame(rows, "machine_id_std string, window_start timestamp_ntz, split_set string, x double")
    for size in (2, 8640):
        out = im.impute_hourly_signals(grid, ["x"], (), chunk_hours=size).orderBy("machine_id_std", "window_start").collect()
        got = {m: [r["x"] for r in out if r["machine_id_std"] == m] for m in ("gaps", "one", "none")}
        assert got == {"gaps": [1, 1, 2, 3, 3], "one": [7] * 5, "none": [3.0] * 5}


def test_split_is_strict_at_the_quantile_hour(spark):
    rows = [(f"m{i}", hour(h)) for h in range(11) for i in range(2)]
    grid = spark.createDataFrame(rows, "machine_id_std string, window_start timestamp_ntz")
    out = {r["window_start"]: r["split_set"] for r in hr.add_temporal_split(grid).collect()}
    q70 = pd.Series([hour(h) for h in range(11) for _ in range(2)]).quantile(0.70)
    assert q70 == hour(7)
    assert out[hour(6)] == "train" and out[hour(7)] == "validation" and out[hour(10)] == "test"


def test_grid_rows_per_hour_equals_the_counted_grid(spark):
    rows = [("a", hour(0), hour(5)), ("b", hour(3), hour(3)), ("c", hour(20), hour(22))]
    bounds = spark.createDataFrame(rows, "machine_id_std string, first_hour timestamp_ntz, last_hour timestamp_ntz")
    counted = hr.hourly_grid(bounds, 1).groupBy("window_start").count()
    quick = hr.grid_rows_per_hour(bounds).select(hr.hour_to_ts(F.col("hour")).alias("window_start"), F.col("n").alias("count"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, quick.collect()))


def events(spark, hours, machine="A"):
    rows = [(f"I{i}", machine, hour(h), 1 + i % 4, *([1] + [0] * 8)) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, INCIDENTS)


def grid_of(spark, n, machine="A"):
    return spark.createDataFrame([(machine, hour(h)) for h in range(n)], "machine_id_std string, window_start timestamp_ntz")


@pytest.mark.parametrize("size", [5, 8640])
def test_label_frame_includes_the_current_hour(spark, size):
    counted = grid_of(spark, 30).withColumn("incident_count_1h", F.when(F.hour("window_start") == 10, 1).otherwise(0))
    counted = counted.filter(F.col("window_start") < F.lit(hour(24)))
    out = ft.add_future_labels(counted, chunk_hours=size).orderBy("window_start").collect()
    assert [i for i, r in enumerate(out) if r["label_failure_next_6h"]] == list(range(5, 11))
    assert out[0]["window_end"] == hour(1)
    nxt = ft.add_future_labels(counted, include_current=False, chunk_hours=size).orderBy("window_start").collect()
    assert [i for i, r in enumerate(nxt) if r["label_failure_next_6h"]] == list(range(4, 10))
    cut = ft.add_future_labels(counted, censored=True, chunk_hours=size).orderBy("window_start").collect()
    assert [r["label_failure_next_6h"] for r in cut[17:]] == [False, False] + [None] * 5


@pytest.mark.parametrize("size", [7, 8640])
def test_event_history(spark, size):
    out = ft.add_incident_context(grid_of(spark, 60), events(spark, [5, 5, 23]), size).orderBy("window_start").collect()
    since = [r["hours_since_last_incident"] for r in out]
    assert since[:6] == [-1] * 5 + [0] and since[22:25] == [17, 0, 1] and since[41] == 18
    assert [out[h]["incident_count_prev_24h"] for h in (4, 5, 28, 29)] == [0, 2, 3, 1]
    assert out[59]["incident_count_prev_7d"] == 3 and out[5]["type_surchauffe"] == 2
    maintenance = spark.createDataFrame([(1, "A", hour(2))], MAINTENANCE)
    done = ft.add_maintenance_context(grid_of(spark, 60), maintenance, size).orderBy("window_start").collect()
    assert done[38]["days_since_last_maintenance"] == 1.5 and done[1]["days_since_last_maintenance"] == -1
    assert done[59]["maintenance_count_prev_30d"] == 1


def random_grid(spark, n=400, machines=3, seed=1):
    rng = np.random.default_rng(seed)
    frame = pd.concat([
        pd.DataFrame({"machine_id_std": f"m{m}", "window_start": [hour(h) for h in range(n)],
                      "split_set": ["train" if h < 280 else "test" for h in range(n)],
                      **{f"{p}_mean_1h": 1500 + rng.normal(size=n).cumsum() for p in SIGNALS}}) for m in range(machines)
    ])
    schema = "machine_id_std string, window_start timestamp_ntz, split_set string, " + ", ".join(f"{p}_mean_1h double" for p in SIGNALS)
    rows = [(m, t.to_pydatetime(), *map(str, s[:1]), *map(float, s[1:])) for m, t, *s in frame.itertuples(index=False)]
    return frame.reset_index(drop=True), spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [50, 8640])
def test_rolling_statistics_against_pandas(spark, size):
    frame, grid = random_grid(spark)
    got = ft.add_trend_features(ft.add_memory_features(grid, size), size).toPandas().sort_values(["machine_id_std", "window_start"])
    groups = frame.groupby("machine_id_std")
    for p in SIGNALS:
        x = groups[f"{p}_mean_1h"]
        for n in (6, 12, 24):
            roll = x.rolling(n, min_periods=1)
            for stat, want in (("mean", roll.mean()), ("max", roll.max()), ("std", roll.std().fillna(0))):
                np.testing.assert_allclose(got[f"{p}_{stat}_{n}h"], want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[f"{p}_delta_3h"], (frame[f"{p}_mean_1h"] - x.shift(3)).fillna(0), atol=1e-9)


def test_constant_and_single_row_machines_score_zero(spark):
    rows = [("const", hour(h), "train", 0.1) for h in range(30)] + [("one", hour(0), "train", 3.3)]
    cols = ", ".join(f"{p}_mean_1h double" for p in SIGNALS)
    grid = spark.createDataFrame([(*r[:3], *[r[3]] * 4) for r in rows], "machine_id_std string, window_start timestamp_ntz, split_set string, " + cols)
    for r in ft.add_anomaly_features(ft.add_memory_features(grid)).collect():
        assert r["temp_zscore_24h"] == 0 and r["temp_zscore_machine"] == 0 and r["temp_std_24h"] == 0


def sources(spark, shift=0.0, tail_from=10**9):
    rng = np.random.default_rng(5)
    rows, seq = [], 0
    for m in ("A", "B", "C"):
        for h in range(120):
            if rng.random() < 0.7:
                temp = float(rng.normal(50, 5)) + (shift if m == "A" else 0.0) + (1000.0 if h >= tail_from else 0.0)
                rows.append((seq, m, hour(h) + timedelta(minutes=int(rng.integers(60))), temp, 200.0 + h, 220.0, 1500.0, int(rng.integers(9))))
                seq += 1
    machines = spark.createDataFrame([("A", None, 800, 50, "x", "l", "h", "LOW")], MACHINES)
    # Events before, inside and after the telemetry of a machine.
    incidents = spark.createDataFrame(
        [(f"I{i}", m, hour(h), 2, *[1] * 9) for i, (m, h) in enumerate([("A", -50), ("A", 10), ("A", 60), ("B", 90), ("C", 500), ("Z", 3)])], INCIDENTS)
    maintenance = spark.createDataFrame([(1, "A", hour(-40)), (2, "B", hour(7)), (3, "B", hour(7)), (4, "C", hour(300))], MAINTENANCE)
    return build_silver_telemetry(telemetry(spark, rows)), incidents, machines, maintenance


def step_by_step(spark, silver, incidents, machines, maintenance):
    """The gold table through the single-family functions."""
    grid = hr.add_temporal_split(hr.complete_hourly_grid(hr.aggregate_hourly(silver)))
    df = ft.add_machine_reference(im.impute_hourly_signals(grid), machines)
    df = ft.add_maintenance_context(ft.add_incident_context(df, incidents), maintenance)
    df = ft.add_anomaly_features(ft.add_trend_features(ft.add_memory_features(df)))
    return ft.order_gold_columns(ft.add_future_labels(ft.add_production_features(df)))


def as_frame(df):
    return df.select(*GOLD_COLUMNS).toPandas().sort_values(["machine_id_std", "window_start"]).reset_index(drop=True)


def test_gold_plan_equals_the_single_steps_whatever_the_chunks(spark):
    frames = sources(spark)
    want = as_frame(step_by_step(spark, *frames))
    for size in (31, 8640):
        got = build_gold(*frames, chunk_hours=size)
        assert got.columns == GOLD_COLUMNS and len(GOLD_COLUMNS) == 113
        pd.testing.assert_frame_equal(as_frame(got), want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_no_leakage_between_machines_or_from_later_splits(spark):
    base, other = as_frame(build_gold(*sources(spark))), as_frame(build_gold(*sources(spark, shift=3.0)))
    rest = base["machine_id_std"] != "A"
    pd.testing.assert_frame_equal(base[rest], other[rest])
    # Later values move neither the training medians nor the baseline of hours that interpolation cannot reach.
    late = as_frame(build_gold(*sources(spark, tail_from=110)))
    early = base["window_start"] < hour(80)
    pd.testing.assert_frame_equal(base[early], late[early])


def test_gold_writes_and_shuffles_cells_not_the_grid(spark):
    silver = build_silver_telemetry(telemetry(spark, [(k, "A", hour(h), 50.0, 200.0, 220.0, 1500.0, 3) for k, h in enumerate((0, 2500, 9000))]))
    _, incidents, machines, maintenance = sources(spark)
    mark = storage.written_so_far(spark)
    gold = build_gold(silver, incidents.limit(0), machines, maintenance.limit(0))
    for path in storage._written[spark.sparkContext.applicationId][mark:]:
        assert spark.read.parquet(path).count() <= 3
    assert gold.count() == 9001


def test_grid_needs_no_join_with_its_hours(spark):
    rows = [("A", hour(h), float(h)) for h in (0, 3, 9000)] + [("B", hour(5), 1.0), ("B", hour(5), 2.0), ("B", hour(7), 3.0), ("B", None, 4.0)]
    hourly = spark.createDataFrame(rows, "machine_id_std string, window_start timestamp_ntz, x double")
    grid = hr.complete_hourly_grid(hourly)
    got = sorted(((r.machine_id_std, r.window_start, r.x) for r in grid.where("machine_id_std = 'B'").collect()), key=str)
    assert got == [("B", hour(5), 1.0), ("B", hour(5), 2.0), ("B", hour(6), None), ("B", hour(7), 3.0)]
    a = grid.where("machine_id_std = 'A'")
    assert a.count() == 9001 and sorted(r.x for r in a.where("x IS NOT NULL").collect()) == [0.0, 3.0, 9000.0]
    assert "window_start" not in "".join(line for line in grid._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)


def test_hours_of_a_grid_are_written_out_by_many_tasks(spark):
    bounds = spark.createDataFrame([(f"m{k}", hour(0), hour(40)) for k in range(64)], "machine_id_std string, first_hour timestamp_ntz, last_hour timestamp_ntz")
    used = hr.hourly_grid(bounds).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_medians_read_only_training_rows_that_hold_values(spark):
    rows = [(k, "train" if k < 60 else "test", float(k) if k % 10 == 0 else None, None) for k in range(100)]
    grid = spark.createDataFrame(rows, "h long, split_set string, a double, b double")
    mark = storage.written_so_far(spark)
    found = im.train_medians(grid, ["a", "b"], F.col("split_set") == "train")
    written = storage._written[spark.sparkContext.applicationId][mark:]
    assert tuple(found.first()) == (25.0, None) and any(spark.read.parquet(p).count() == 6 for p in written)


def test_baseline_meets_the_hours_where_their_windows_run(spark):
    rows = [(m, hour(h), "train" if h < 40 else "test", *[float(h % 5)] * 4) for m in "AB" for h in range(60)]
    grid = spark.createDataFrame(rows, "machine_id_std string, window_start timestamp_ntz, split_set string, " + ", ".join(f"{p}_mean_1h double" for p in SIGNALS))
    done = ft.add_anomaly_features(grid, chunk_hours=13)
    whole = ft.add_anomaly_features(grid).toPandas().sort_values(["machine_id_std", "window_start"]).reset_index(drop=True)
    got = done.toPandas().sort_values(["machine_id_std", "window_start"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, whole, rtol=1e-9, atol=1e-9)
    exchanges = [line for line in done._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip(" +-:").startswith("Join")]
    assert exchanges and any("__chunk" in line for line in exchanges)
