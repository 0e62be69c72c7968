"""Class balance: counts, weights, exact seeded sampling, stratified split and classifier metrics.

Exact sampling needs a global rank per class. ``hash_rank`` gives it without one task per class: rows
are ranked inside (class, first hex digits of the hash) buckets and the bucket's offset is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.neighbours import nearest
from millwright.functions.storage import attach_row, materialize

#: Copies of a row that one task makes of one input row.
COPIES_AT_ONCE = 4096


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return attach_row(counts, total).select(label, "n", (F.col("n") / F.col("__total")).alias("share"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight ``rows / (classes * class rows)`` per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__k"))
    return attach_row(counts, total).select(label, (F.col("__total") / (F.col("__k") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """The weight of each row's class; rows without a label are a class of their own."""
    weights = class_weights(df, label).select(F.col(label).alias("__label"), F.col("weight").alias(name))
    return df.join(weights, F.col(label).eqNullSafe(F.col("__label"))).select(*df.columns, name)


def hash_rank(df: DataFrame, label: str, key: str, seed: int, digits: int = 4) -> DataFrame:
    """Add ``__rank`` (1-based, by md5 of seed and unique key) and ``__class_n`` per class.

    Rows without a label are a class of their own; a null key is a key like any other.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = df.withColumns({"__code": code, "__bucket": F.substring(code, 1, digits)})
    sizes = rows.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    # At most 16 ** digits rows per class.
    upto = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    offsets = sizes.select(
        F.col(label).alias("__label"), F.col("__bucket").alias("__part"), F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__offset"),
        F.sum("__size").over(whole).alias("__class_n"),
    )
    inside = Window.partitionBy(label, "__bucket").orderBy("__code", key)
    mine = F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__part"))
    ranked = rows.join(offsets, mine).withColumn("__rank", F.col("__offset") + F.row_number().over(inside))
    return ranked.drop("__code", "__bucket", "__offset", "__label", "__part")


def _class_range(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min("n").alias("__least"), F.max("n").alias("__most"))


def downsample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement, exactly and repeatably."""
    ranked = attach_row(hash_rank(df, label, key, seed), _class_range(df, label))
    return ranked.filter(F.col("__rank") <= F.col("__least")).select(*df.columns)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class raised to the size of the largest by repeating rows as evenly as possible.

    Which rows get the extra copy is drawn by hash. ``copy`` numbers the repeats from 0. Copies are made in two steps
    with a redistribution between, so a few rows against a huge class fill more than one task.
    """
    ranked = attach_row(hash_rank(df, label, key, seed), _class_range(df, label))
    base = F.floor(F.col("__most") / F.col("__class_n"))
    extra = (F.col("__rank") <= F.col("__most") % F.col("__class_n")).cast("long")
    zero, copies = F.lit(0).cast("long"), base + extra
    chunks = ranked.withColumns({"__copies": copies, "__chunk": F.explode(F.sequence(zero, F.floor((copies - 1) / COPIES_AT_ONCE)))})
    spread = chunks.repartition(F.col(key), F.col("__chunk"))
    first = F.col("__chunk") * COPIES_AT_ONCE
    last = F.least(first + COPIES_AT_ONCE, F.col("__copies")) - 1
    return spread.withColumn("copy", F.explode(F.sequence(first, last))).select(*df.columns, "copy")


def _draw(text: Column, first: int = 1, digits: int = 15) -> Column:
    """A number from so many hexadecimal digits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text), first, digits), 16, 10).cast("long")


def _text(*parts) -> Column:
    return F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p.cast("string") for p in parts))


def oversample_with_replacement(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class smaller than the largest replaced by as many independent draws of its rows as the largest has.

    Draw number ``draw`` of a class takes the row whose hash rank is the draw's own hash modulo the class size, so a
    row's number of copies is that of drawing with replacement, class sizes are exact and runs repeat. Draws are made
    where they are joined: none needs an order over the class. The largest classes keep their rows, with a null draw.
    """
    ranked = attach_row(hash_rank(df, label, key, seed), _class_range(df, label)).withColumn("__row", F.col("__rank"))
    sizes = ranked.groupBy(label).agg(F.first("__class_n").alias("__n"), F.first("__most").alias("__want")).where("__n < __want")
    chunks = sizes.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__want") - 1) / COPIES_AT_ONCE))))
    chunks = chunks.repartition(F.col(label), F.col("__chunk"))
    first = F.col("__chunk") * COPIES_AT_ONCE
    draws = chunks.withColumn("draw", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col("__want")) - 1)))
    draws = draws.select(F.col(label).alias("__label"), "draw", (_draw(_text(F.lit(seed), label, "draw")) % F.col("__n") + 1).alias("__drawn"))
    taken = ranked.where(F.col("__class_n") < F.col("__most")).join(draws, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__row") == F.col("__drawn")))
    whole = ranked.where(F.col("__class_n") == F.col("__most")).withColumn("draw", F.lit(None).cast("long"))
    return whole.select(*df.columns, "draw").unionByName(taken.select(*df.columns, "draw"))


def smote(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = 5, seed: int = 42, split: str | None = None) -> DataFrame:
    """(label, key, neighbour, copy, features): synthetic rows that raise every class to the size of the largest.

    A synthetic row lies between the row ``key`` and one of its ``k`` nearest of the same class, which is drawn by hash, as
    is the place between them; rows take turns by hash rank. Rows need all features and a label; keys are unique. A
    class of one row is repeated, with a null neighbour. A named ``split`` column must hold nothing but ``train``: synthetic
    rows made of others would carry them into the fit.
    """
    if split and not df.where(~F.col(split).eqNullSafe("train")).isEmpty():
        raise ValueError("synthetic rows are made of training rows only: split first")
    rows = materialize(df.select(label, key, *(F.col(f).cast("double").alias(f) for f in features)).na.drop(), "smote-rows")
    ranked = attach_row(hash_rank(rows, label, key, seed), _class_range(rows, label)).where(F.col("__class_n") < F.col("__most"))
    wanted = F.col("__most") - F.col("__class_n")
    extra = (F.col("__rank") <= wanted % F.col("__class_n")).cast("long")
    ranked = ranked.withColumn("__copies", F.floor(wanted / F.col("__class_n")) + extra).where("__copies > 0")
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a class
    near = None
    for value in sorted((v for v, n in counts.items() if 1 < n < max(counts.values())), key=str):
        own = rows.where(F.col(label) == value)
        found = nearest(own, own, features, key, k + 1).select(*(F.col(f).alias(f"__{f}") for f in features), F.col("key").alias("__of"), "point", "rank")
        same = reduce(lambda a, b: a & b, (F.col(f) == F.col(f"__{f}") for f in features))
        beside = own.join(found, same).where(F.col(key) != F.col("__of")).groupBy(key).agg(
            F.slice(F.sort_array(F.collect_list(F.struct("rank", F.col("__of").alias("of"), "point"))), 1, k).alias("__near")
        ).withColumnRenamed(key, "__own")
        near = beside if near is None else near.unionByName(beside)
    if near is None:
        near = rows.limit(0).select(F.col(key).alias("__own"), F.array(F.struct(F.lit(1).alias("rank"), F.col(key).alias("of"), F.array(*features).alias("point"))).alias("__near"))
    zero = F.lit(0).cast("long")
    chunks = ranked.join(near, F.col(key) == F.col("__own"), "left").withColumn("__chunk", F.explode(F.sequence(zero, F.floor((F.col("__copies") - 1) / COPIES_AT_ONCE))))
    spread = chunks.repartition(F.col(key), F.col("__chunk"))
    first = F.col("__chunk") * COPIES_AT_ONCE
    made = spread.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES_AT_ONCE, F.col("__copies")) - 1)))
    name = _text(F.lit(seed), key, "copy")
    picked = F.when(F.size("__near") > 0, F.element_at("__near", (_draw(name, 1, 8) % F.size("__near") + 1).cast("int")))
    made = made.withColumns({"__pick": picked, "__part": _draw(name, 9, 8) / F.lit(float(1 << 32))})
    between = [F.col(f) + F.col("__part") * (F.coalesce(F.col("__pick.point")[i], F.col(f)) - F.col(f)) for i, f in enumerate(features)]
    return made.select(label, key, F.col("__pick.of").alias("neighbour"), "copy", *(b.alias(f) for b, f in zip(between, features)))


def concat_classes(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``part``: in every class the first ``round(n * test_share)`` rows by hash go to test."""
    ranked = hash_rank(df, label, key, seed)
    cut = F.floor(F.col("__class_n") * test_share + 0.5)
    return ranked.withColumn("part", F.when(F.col("__rank") <= cut, "test").otherwise("train")).select(*df.columns, "part")


def confusion_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: the confusion matrix, accuracy, precision, recall and F1 of the positive class (0/1 columns)."""
    y, p = F.col(label) == 1, F.col(predicted) == 1

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    one = df.agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    return one.selectExpr(
        "tp", "fp", "fn", "tn",
        "try_divide(tp + tn, tp + fp + fn + tn) AS accuracy",
        "coalesce(try_divide(tp, tp + fp), 0D) AS precision",
        "coalesce(try_divide(tp, tp + fn), 0D) AS recall",
        "coalesce(try_divide(2 * tp, 2 * tp + fp + fn), 0D) AS f1",
    )


def ranking_metrics(df: DataFrame, label: str, score: str, pieces: int = 256) -> DataFrame:
    """One row: ROC-AUC (ties count half) and average precision (PR-AUC), exact.

    Rows collapse to one per distinct score first. Running totals over the scores are taken inside
    score ranges cut at sketched quantiles, plus the totals of the ranges above.
    """
    per_score = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    )
    cuts = per_score.agg(F.percentile_approx("score", [i / pieces for i in range(1, pieces)], 10 * pieces).alias("__cuts"))
    piece = F.size(F.filter(F.col("__cuts"), lambda c: c < F.col("score")))
    rows = attach_row(per_score, cuts).select("score", "pos", "neg", piece.alias("piece"))
    totals = rows.groupBy("piece").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
    totals = totals.select(
        "piece", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0")
    )
    down = Window.partitionBy("piece").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    curve = rows.join(totals, "piece").select(
        "pos", "neg", (F.col("p0") + F.sum("pos").over(down)).alias("tp"), (F.col("n0") + F.sum("neg").over(down)).alias("fp")
    )
    # Each distinct score adds the pairs it wins: negatives here against the positives above plus half of its own.
    one = curve.agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)).alias("won"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )
    return one.selectExpr(
        "try_divide(won, CAST(positives AS DOUBLE) * negatives) AS roc_auc", "try_divide(area, positives) AS average_precision"
    )
