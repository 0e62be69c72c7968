"""The pipeline on a small corpus: each stage's decisions, nulls, repeated rows and an empty table."""

from __future__ import annotations

import os
import random

import corpus_pipeline
from pyspark.sql import functions as F

from millwright.functions import storage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(30)) for k in range(5)]
    clean = [(k, prose(120)) for k in range(60)]
    junk = [(100 + k, " ".join(f"{w.upper()}!!$$$ ###" for w in prose(60).split())) for k in range(60)]
    copies = [(200 + k, clean[k][1]) for k in range(10)]
    edited = []
    for k in range(10, 20):
        words = clean[k][1].split()
        words[60] = "edited"
        edited.append((300 + k, " ".join(words)))
    leaks = [(400 + k, f"{prose(50)} {items[k][1]} {prose(50)}") for k in range(5)]
    lines = [(500 + k, f"{prose(60)}\nAll about our cookies on page {k} of this site here\n{prose(60)}") for k in range(8)]
    odd = [(600, None), (601, ""), (602, "short"), (None, prose(90)), (603, "same " * 200), *clean[:2]]
    return items, clean, junk, copies, edited, leaks, lines, odd


def test_stages(spark, tmp_path):
    items, clean, junk, copies, edited, leaks, lines, odd = corpus()
    data = [*clean, *junk, *copies, *edited, *leaks, *lines, *odd]
    spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in data], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labelled = [(i, 1, 0) for i, _ in clean[:40]] + [(i, 0, 0) for i, _ in junk[:40]]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = docs.collect()

    ids = lambda name: [r.doc_id for r in left[name]]
    good = {i for i, _ in [*clean, *copies, *edited, *leaks, *lines]} | {None}
    assert set(ids("quality_rules")) == good and len(ids("quality_rules")) == len(good) + 2
    assert len(left["line_dedup"]) == len(left["quality_rules"])
    assert sum("cookies" in r.text for r in left["line_dedup"]) == 1 and all(r.n_chars == len(r.text) for r in left["line_dedup"])
    assert sorted(map(str, ids("near_dedup"))) == sorted(map(str, good - {i for i, _ in [*copies, *edited]}))
    assert set(ids("decontamination")) == set(ids("near_dedup")) - {i for i, _ in leaks}
    tokens = {r.doc_id: len(r.text.split()) + 1 for r in left["decontamination"]}
    packed = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert packed == tokens

    before = set(os.listdir(f"{storage.shared_dir(spark)}/millwright"))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    stay = {p.split("-")[0] for p in set(os.listdir(f"{storage.shared_dir(spark)}/millwright")) - before}
    assert stay == {"stage", "pieces"}  # what the last stage reads and wrote; all else was removed on the way
    assert sorted(map(str, whole.collect())) == sorted(map(str, left["packing"]))


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_clashing_columns(spark):
    from millwright.llm import line_dedup, near_copies

    data = [(k, f"one line of words here {k % 2}\nshared line of plain words number {k}", "m", "o", "g", "i", 7) for k in range(6)]
    table = spark.createDataFrame([*data, data[0]], "doc_id long, text string, mark string, of string, Gone string, its string, dropped_lines int")
    left = near_copies.keep_one_of_each(table)
    assert left.columns == table.columns and {tuple(r) for r in left.collect()} <= set(data)
    lines = line_dedup.drop_recurring_lines(table)
    assert lines.columns == table.columns and {tuple(r)[2:6] for r in lines.collect()} == {("m", "o", "g", "i")} and lines.count() == 7
