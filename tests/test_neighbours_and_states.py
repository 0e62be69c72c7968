"""Nearest neighbours, synthetic rows, similar texts, keyed tables, stored pages and dump comments against plain Python."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwright.functions import neighbours
from millwright.operators import balance, impute, near, states
from millwright.sinks import keyed
from millwright.sources import layers, sql_dump


def brute_nearest(points, query, k):
    found = sorted((round(sum((a - b) ** 2 for a, b in zip(p, query)), 9), key) for key, p in points)
    return found[:k]


@pytest.mark.parametrize("sample,band,pivots", [(4, 8, 5), (256, 2048, 32), (16, 3, 1)])
def test_nearest_is_exact(spark, monkeypatch, sample, band, pivots):
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "BAND", band)
    rng = np.random.default_rng(3)
    clusters = rng.normal(size=(6, 3)) * 5
    points = [(k, tuple(np.round(clusters[k % 6] + rng.normal(size=3), 1).tolist())) for k in range(400)]
    points += [(1000 + k, (0.5, 0.5, 0.5)) for k in range(300)]  # one hot point
    asked = [tuple(np.round(rng.normal(size=3) * 6, 2).tolist()) for _ in range(40)] + [(0.5, 0.5, 0.5), points[0][1], (1e6, 0.0, 0.0)]
    table = spark.createDataFrame([(k, *p) for k, p in points], "id long, x double, y double, z double")
    queries = spark.createDataFrame([(*q,) for q in asked * 2], "x double, y double, z double")
    found = neighbours.nearest(queries, table, ["x", "y", "z"], "id", 7, pivots=pivots).collect()
    for q in asked:
        mine = sorted((r.rank, r.squared_distance, r.key) for r in found if (r.x, r.y, r.z) == q)
        assert [m[2] for m in mine] == [key for _, key in brute_nearest(points, q, 7)]
    few = neighbours.nearest(queries, table.where("id < 3"), ["x", "y", "z"], "id", 7)
    assert few.count() == 3 * len(set(asked)) and neighbours.nearest(queries, table.limit(0), ["x", "y", "z"], "id", 7).count() == 0


def joined_rows(found):
    """The most rows that a join of the plan behind ``found`` made."""
    rows, todo = [0], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif "Join" in kind:
            rows.append(node.metrics().get("numOutputRows").get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return max(rows)


def test_queries_meet_no_more_points_in_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 16)
    monkeypatch.setattr(neighbours, "BAND", 64)
    rng, met = np.random.default_rng(8), []
    asked = rng.random((40, 3))
    queries = spark.createDataFrame([tuple(q) for q in asked.tolist()], "x double, y double, z double")
    for n in (2_000, 32_000):
        points = rng.random((n, 3))
        table = spark.createDataFrame([(k, *p) for k, p in enumerate(points.tolist())], "id long, x double, y double, z double")
        found = neighbours.nearest(queries, table, ["x", "y", "z"], "id", 3)
        nearest = {}
        for r in found.collect():
            nearest.setdefault((r.x, r.y, r.z), []).append((r.rank, r.key))
        for q in asked:
            at = np.argsort(((points - q) ** 2).sum(axis=1))[:3].tolist()
            assert [key for _, key in sorted(nearest[tuple(q.tolist())])] == at
        met.append(joined_rows(found))
    assert 0 < met[1] < 3 * met[0], met


def test_knn_imputation(spark):
    rng = random.Random(4)
    data = [(k, rng.choice([None, *range(5)]), rng.random() if rng.random() < 0.9 else None, None if rng.random() < 0.3 else rng.random(), k % 4 > 0) for k in range(200)]
    table = spark.createDataFrame([(k, float(a) if a is not None else None, b, c, t) for k, a, b, c, t in data], "id long, a double, b double, c double, train boolean")
    done = {r.id: r.c for r in impute.impute_knn(table, ["c"], "id", 3, F.col("train"), ["a", "b", "c"]).collect()}
    train = [r for r in data if r[4]]
    mean = [np.mean([r[i] for r in train if r[i] is not None]) for i in (1, 2)]
    std = [np.std([r[i] for r in train if r[i] is not None], ddof=1) for i in (1, 2)]
    at = lambda r: tuple((mean[i] if r[i + 1] is None else r[i + 1]) / std[i] for i in range(2))
    donors = [(r[0], at(r)) for r in train if r[3] is not None]
    value = {r[0]: r[3] for r in data}
    for r in data:
        wanted = r[3] if r[3] is not None else np.mean([value[key] for _, key in brute_nearest(donors, at(r), 3)])
        assert abs(done[r[0]] - wanted) < 1e-9
    nobody = impute.impute_knn(table.withColumn("c", F.lit(None).cast("double")), ["c"], "id", 3, features=["a", "b", "c"])
    assert nobody.where("c IS NOT NULL").count() == 0 and nobody.columns == table.columns


def test_synthetic_rows_lie_between_their_parents(spark):
    rng = random.Random(6)
    data = [(k, "rare" if k % 9 == 0 else "one" if k == 7 else "many", rng.random(), float(rng.randrange(3)), "train") for k in range(180)]
    table = spark.createDataFrame(data, "id long, label string, x double, y double, part string")
    made = balance.smote(table, "label", "id", ["x", "y"], k=4, split="part").collect()
    at = {r[0]: r for r in data}
    sizes = {label: sum(r[1] == label for r in data) for label in ("rare", "one", "many")}
    assert {label: sum(r.label == label for r in made) for label in ("rare", "one")} == {label: sizes["many"] - sizes[label] for label in ("rare", "one")}
    points = [(r[0], r[2:4]) for r in data if r[1] == "rare"]
    for r in made:
        if r.label == "one":
            assert r.neighbour is None and (r.x, r.y) == at[r.id][2:4]
            continue
        near_ids = [key for _, key in brute_nearest([p for p in points if p[0] != r.id], at[r.id][2:4], 4)]
        share = [(m - a) / (b - a) for m, a, b in zip((r.x, r.y), at[r.id][2:4], at[r.neighbour][2:4]) if a != b]
        assert r.neighbour in near_ids and all(0 <= s < 1 for s in share) and max(share) - min(share) < 1e-6
    with pytest.raises(ValueError):
        balance.smote(table.withColumn("part", F.when(F.col("id") == 3, "test").otherwise("train")), "label", "id", ["x", "y"], split="part")


def test_draws_with_replacement(spark):
    table = spark.createDataFrame([(k, "few" if k < 40 else None if k < 70 else "many") for k in range(6070)], "id long, label string")
    drawn = balance.oversample_with_replacement(table, "label", "id", seed=3)
    assert {r.label: r["count"] for r in drawn.groupBy("label").count().collect()} == {"few": 6000, None: 6000, "many": 6000}
    times = [r["count"] for r in drawn.where("label = 'few'").groupBy("id").count().collect()]
    assert len(times) == 40 and 60 < np.var(times) < 320  # the multinomial's is 146; even repetition has none
    again = balance.oversample_with_replacement(table.repartition(7), "label", "id", seed=3)
    assert again.exceptAll(drawn).isEmpty()


def test_similar_texts(spark):
    rng = random.Random(9)
    words = ["pump", "valve", "noise", "high", "low", "pressure", "stop", "line"]
    data = [(k, "m1" if k % 3 else "m2", " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    data += [(200 + k, "m1", t) for k, t in enumerate(["", "a", "A", "ab", None, "pump", "PUMP "])] + [(300, None, "pump")]
    table = spark.createDataFrame(data, "id long, machine string, text string")
    found = {(r.representative, r.other): r.similarity for r in near.near_in_text(table, ["machine"], "id", "text").collect()}
    first = {}
    for key, machine, text in sorted(data, key=lambda r: r[0]):
        if text is not None and machine is not None:
            first.setdefault((machine, text.lower()), key)
    grams = lambda t: {t[i:i + 3] for i in range(max(1, len(t) - 2))}
    wanted = {}
    for (m, t), a in first.items():
        for (n, u), b in first.items():
            j = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
            if m == n and a < b and j >= 0.8 - 1e-9:
                wanted[a, b] = j
    assert set(found) == set(wanted) and all(abs(found[p] - wanted[p]) < 1e-9 for p in wanted) and len(wanted) > 3
    classes = {r.id: r.representative for r in near.text_classes(table, ["machine"], "id", "text").collect()}
    assert classes == {k: first[m, t.lower()] for k, m, t in data if t is not None and m is not None}


def test_states_merge(spark):
    table = spark.createDataFrame([(k % 10, k % 700, float(k % 1000) if k % 5 else None) for k in range(20_000)], "day int, machine int, v double")
    month = states.merged_distinct(states.distinct_states(table, ["day"], "machine"), []).first().n_distinct
    assert abs(month - 700) < 4 * 700 * 1.04 / 64
    q = states.merged_quantiles(states.quantile_states(table, ["day"], ["v"]), [], [0.1, 0.5, 0.9]).first()
    values = np.sort([float(k % 1000) for k in range(20_000) if k % 5])
    assert q.n == len(values)
    for share, value in zip((0.1, 0.5, 0.9), q.quantiles):
        low, high = np.searchsorted(values, value) / len(values), np.searchsorted(values, value, "right") / len(values)
        assert low - states.RANK_ERROR <= share <= high + states.RANK_ERROR


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = f"{tmp_path}/keyed"
    table = spark.createDataFrame([(None if k == 0 else k, f"old {k}") for k in range(500)], "id long, v string")
    keyed.write_keyed(table, path, ["id"], 16)
    before = files(path)
    new = spark.createDataFrame([(None, "new", 1), (5, "first", 1), (5, "last", 2), (9001, "more", 1)], "id long, v string, at int")
    touched = keyed.upsert_keyed(spark, path, new, ["id"], 16, order="at")
    after = files(path)
    changed = {f.split(f"{keyed.BUCKET}=")[1].split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert 1 <= len(touched) <= 3 and changed == {str(t) for t in touched}
    rows = {r.id: r.v for r in keyed.read_keyed(spark, path).collect()}
    assert rows == {**{k: f"old {k}" for k in range(1, 500)}, None: "new", 5: "last", 9001: "more"}
    assert keyed.upsert_keyed(spark, path, new.drop("at").limit(0), ["id"], 16) == []
    with pytest.raises(ValueError):
        keyed.upsert_keyed(spark, path, new.withColumn("other", F.lit(1)), ["id"], 16, order="at")


def test_pages_read_few_parts(spark, tmp_path):
    path = f"{tmp_path}/paged"
    data = [(k % 997, k) for k in range(5000)]
    layers.write_pages(spark.createDataFrame(data, "a long, b long").repartition(5), ["a", "b"], path, part_rows=250)
    ordered = sorted(data)
    for offset, limit in ((0, 10), (2490, 30), (4990, 50), (6000, 10), (-3, 0)):
        page = layers.stored_page(spark, path, ["a", "b"], limit, offset)
        start, size = max(offset, 0), max(1, min(limit, 500))
        assert [tuple(r) for r in page.collect()] == ordered[start:start + size]
        read = set(page.inputFiles())
        assert len(read) < 21
    plan = layers.stored_page(spark, path, ["a", "b"], 30, 2490)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and layers.PART in plan


def test_pages_are_cut_inside_a_bounded_number_of_ranges(spark, tmp_path):
    path, ranges = f"{tmp_path}/paged", int(spark.conf.get("spark.sql.shuffle.partitions"))
    layers.write_pages(spark.createDataFrame([(1, k) for k in range(3000)] + [(2, k) for k in range(100)], "a long, b long"), ["a"], path, part_rows=50)
    index = spark.read.parquet(f"{path}/index").collect()
    assert max(r["rows"] for r in index) <= 55 and len({r[layers.PART] >> 33 for r in index}) <= ranges
    seen = [r["b"] for at in range(0, 3100, 310) for r in layers.stored_page(spark, path, ["a"], 310, at).collect()]
    assert len(seen) == 3100 and sorted(seen[:3000]) == list(range(3000))  # rows equal in the order: each on one page


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_dump_comments_hold_quotes(spark, tmp_path, block):
    text = """INSERT INTO machine (a, b) VALUES -- the operators' list
('1', 'it''s -- no comment'), -- don't stop
('2', 'two
lines -- still (quoted)'), -- ')
-- a comment's line
('3', 'x'), ('4', -- in the middle isn't
'y'); -- that's all
INSERT INTO other (a) VALUES ('no');
"""
    (tmp_path / "dump.sql").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = sql_dump.dump_lines(spark, str(tmp_path / "dump.sql"))
        rows = sorted(tuple(r) for r in sql_dump.insert_rows(lines, "machine", ["a", "b"]).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [("1", "it's -- no comment"), ("2", "two\nlines -- still (quoted)"), ("3", "x"), ("4", "y")]
