"""License scans: ordered signature rules behind a keyword filter, as DataFrame expressions only.

A text that no rule can match is told apart by one expression. The others become lines of lower-case words; every rule
whose keyword the line holds is run on it and gives its places as word intervals. An interval inside that of a rule
with at least its priority is suppressed, so "licensed under the apache license version 2 0" is one detection and not
four. What is left names the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.storage import materialize
from millwright.llm.license_rules import GATE, KINDS, rules

#: Phrases that always count, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Relevance of a base phrase alone.
BASE_RELEVANCE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_line(text: Column) -> Column:
    """Words in lower case (A-Z), each between two single blanks; letters, digits and all beyond ASCII make words."""
    lower = F.translate(text, _UPPER, _LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")), F.lit(" "))


def _blanks(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))).cast("long")


def _base_places(line: str = "line") -> list[Column]:
    """n_base, first_word, last_word and base_labels of a word line."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        parts = F.split(F.col(line), f"(?<= ){phrase}(?= )", -1)
        n = (F.size(parts) - 1).cast("long")
        counts.append(n)
        firsts.append(F.when(n > 0, _blanks(F.element_at(parts, 1)) - 1))
        lasts.append(F.when(n > 0, _blanks(F.col(line)) - _blanks(F.element_at(parts, -1)) - phrase.count(" ") - 1))
        labels.append(F.when(n > 0, F.lit(label)))
    return [
        sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base_labels"),
    ]


def detections(lines: DataFrame) -> DataFrame:
    """(id, mark, line) -> (id, mark, rule, label, priority, relevance, start, end): unsuppressed places, as words from 0.

    Suppressed: a place inside another one of equal or higher priority; of equal intervals the rule of higher
    priority stays, then the earlier rule.
    """
    spark = lines.sparkSession
    table = F.broadcast(spark.createDataFrame(rules(), "rule int, label string, keyword string, priority int, relevance double, expression string"))
    keywords = sorted({r[2] for r in rules()})
    held = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("line"), k))
    tried = lines.withColumn("keyword", F.explode(held)).join(table, "keyword")
    at = F.concat(F.lit("(?<= )(?:"), F.col("expression"), F.lit(")(?= )"))
    tried = tried.withColumn("at", at).where("line RLIKE at")
    marked = F.expr("split(regexp_replace(line, at, '\\u0001$0\\u0002'), '[\\u0001\\u0002]', -1)")
    parts = tried.select("id", "mark", "rule", "label", "priority", "relevance", F.posexplode(marked).alias("k", "part"))
    along = Window.partitionBy("id", "mark", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("start", F.sum(_blanks(F.col("part"))).over(along) - 1).where("k % 2 = 1").select(
        "id", "mark", "rule", "label", "priority", "relevance", "start", (F.col("start") + _blanks(F.col("part"))).alias("end")
    )
    outer = Window.partitionBy("id", "mark").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    cover = F.lit(None).cast("long")
    for priority in sorted({p for p, _ in KINDS.values()}):
        reach = F.max(F.when(F.col("priority") >= priority, F.col("end"))).over(outer)
        cover = F.when(F.col("priority") == priority, reach).otherwise(cover)
    return found.withColumn("cover", cover).where("cover IS NULL OR cover < end").drop("cover")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections) for every row of ``docs``.

    ``labels`` joins the base labels and those of all detections, distinct and sorted; ``score`` is the relevance of
    the most telling one, zero if there is none. A null text is an empty one. Rows that agree in id and text are
    scanned once and reported each; null ids are ids like others; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"),
        F.regexp_count(text, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long").alias("n_words"),
        F.when(text.rlike(GATE), word_line(text)).alias("line"),
    )
    rows = materialize(rows, "license-rows")
    lines = rows.where("line IS NOT NULL").groupBy("id", "mark").agg(F.first("line").alias("line"))
    lines = materialize(lines, "license-lines")
    named = detections(lines).groupBy("id", "mark").agg(
        F.collect_set("label").alias("found"), F.max("relevance").alias("relevance"), F.count("*").alias("n_detections")
    )
    base = lines.select("id", "mark", *_base_places())
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["mark"] == b["mark"])
    known = base.join(named, same(base, named), "left").select(base["id"], base["mark"], "n_base", "first_word", "last_word", "base_labels", "found", "relevance", "n_detections")
    known = known.where("n_base > 0 OR found IS NOT NULL")
    nothing = F.array().cast("array<string>")
    ours, theirs = F.coalesce("base_labels", nothing), F.coalesce("found", nothing)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    rows = rows.select("id", "mark", "n_words")
    return rows.join(known, same(rows, known), "left").select(
        rows["id"], "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined(ours).alias("base_labels"), joined(F.array_union(ours, theirs)).alias("labels"),
        F.greatest(F.coalesce("relevance", F.lit(0.0)), F.when(F.size(ours) > 0, BASE_RELEVANCE).otherwise(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0).cast("long")).alias("n_detections"),
    )
