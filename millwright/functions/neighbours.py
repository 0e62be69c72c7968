"""Exact nearest neighbours by a metric join: tiles of about equally many points, and distance bounds that say which to visit.

Slabs of the first feature, cut at quantiles, are cut by the next feature, and so on, until a tile holds a bounded number
of points; features of few values come first. A query's bound is what k points are known to lie within: those of a sample
of its own tile, or, where that is too small, of the whole table. It goes down the slabs, level by level, and visits the
tiles whose box lies within its bound. Tiles do not grow with the table, they become more, so the bounds shrink as points
get denser, and a query meets about as many points in a large table as in a small one.

Equal points are one site with its first keys, so a point that makes up a third of the table is one row of the join.
Large tiles are split by Spark's skew join. Nothing but a bounded sample and the number of slabs reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.storage import materialize

#: Sites of the whole table that bound queries whose tile is too small.
PIVOTS = 32
#: Sites of a tile that bound its queries, and sites of a tile, about.
SAMPLE, BAND = 256, 512
#: Parts at most that one level cuts a slab into.
PARTS = 1024
#: Decimals to which squared distances are compared; nearer ones are ties.
DECIMALS = 9
_SLACK = 2e-9


def squared(left: Sequence, right: Sequence) -> Column:
    return reduce(lambda a, b: a + b, ((x - y) * (x - y) for x, y in zip(left, right)))


def sites(points: DataFrame, features: Sequence[str], key: str, kept: int, value: str | None = None) -> DataFrame:
    """One row for each distinct point: its features, and ``members`` (key, value) of its first ``kept`` rows by key."""
    order = Window.partitionBy(*features).orderBy(key)
    few = points.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= kept)
    member = F.struct(F.col(key).alias("key"), (F.col(value) if value else F.lit(None).cast("double")).alias("value"))
    return few.groupBy(*features).agg(F.sort_array(F.collect_list(member)).alias("members"))


def _cut(at: DataFrame, of: DataFrame) -> DataFrame:
    """``at`` (tile, x) with the number of the part of its slab: the edges up to ``x``."""
    edges = of.select(F.col("tile").alias("of_tile"), "edges")
    part = F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.lit(0))
    return at.join(edges, F.col("tile") == F.col("of_tile"), "left").withColumn("part", part).drop("of_tile", "edges")


def _edges(located: DataFrame, names: Sequence[str]) -> list:
    """(feature, most parts, edges by slab) of each level: where the slabs of the levels before are cut."""
    counts = located.agg(*(F.approx_count_distinct(n).alias(n) for n in names)).first()
    at, levels = located.withColumn("tile", F.lit(0).cast("long")), []
    for i, name in enumerate(sorted(names, key=lambda n: (counts[n], n))):
        parts = F.ceil(F.pow(F.col("n") / BAND, 1 / (len(names) - i)) - 1e-9).cast("int")
        slabs = materialize(at.groupBy("tile").agg(F.count("*").alias("n")).withColumn("parts", F.least(parts, F.lit(PARTS))).where("parts > 1"), "slabs")
        most = slabs.agg(F.max("parts")).first()[0]
        if most is None:
            continue
        cuts = F.percentile_approx(name, [j / most for j in range(1, most)], max(100, 20 * most)).alias("cuts")
        edges = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda j: F.element_at("cuts", F.greatest(F.round(j * most / F.col("parts")).cast("int"), F.lit(1))))
        wide = slabs.select(F.col("tile").alias("of_tile"), "parts")
        wide = at.join(wide, F.col("tile") == F.col("of_tile")).groupBy("tile", "parts").agg(cuts)
        levels.append((name, most, materialize(wide.select("tile", F.array_distinct(edges).alias("edges")), "edges")))
        at = _down(at, levels[-1])
    return levels


def _down(at: DataFrame, level: tuple) -> DataFrame:
    """``at`` one level further down: ``tile`` is that of the part."""
    name, most, edges = level
    return _cut(at.withColumn("x", F.col(name)), edges).withColumn("tile", F.col("tile") * most + F.col("part")).drop("x", "part")


def nearest(queries: DataFrame, points: DataFrame, features: Sequence[str], key: str, k: int, value: str | None = None,
            pivots: int = PIVOTS) -> DataFrame:
    """(features, key, value, point, squared_distance, rank): the ``k`` nearest points of each distinct query point.

    ``point`` has the neighbour's features, ``value`` its value.
    Ties of distance (to nine decimals) go to the smaller key. Keys of points are unique; features are numbers without
    nulls on both sides. With fewer than ``k`` points all are neighbours; without points or queries there are no rows.
    """
    names = [f"f{i}" for i in range(len(features))]
    rows = points.select(*(F.col(f).cast("double").alias(n) for f, n in zip(features, names)), F.col(key).alias("key"),
                         *([F.col(value).cast("double").alias("value")] if value else []))
    located = sites(rows, names, "key", k, "value" if value else None)
    located = materialize(located.where(~F.isnan(reduce(lambda a, b: a + b, (F.col(n) for n in names)))), "sites")
    asked = queries.select(*(F.col(f).cast("double").alias(n) for f, n in zip(features, names))).distinct()
    chosen = [list(p) for p in located.select(*names).orderBy(F.xxhash64(*names), *names).limit(max(pivots, k)).collect()]
    empty = F.lit(None)
    if not chosen:
        kind = points.schema[key].dataType
        return asked.limit(0).select(
            *(F.col(n).alias(f) for n, f in zip(names, features)), empty.cast(kind).alias("key"), empty.cast("double").alias("value"),
            empty.cast("array<double>").alias("point"), empty.cast("double").alias("squared_distance"), empty.cast("int").alias("rank"))
    mine = [F.col(n) for n in names]
    theirs = [F.col(f"p{n}") for n in names]
    levels, top = _edges(located, names), F.lit(0).cast("long")
    stored, asked = located.withColumn("tile", top), asked.withColumn("tile", top)
    for level in levels:
        stored, asked = _down(stored, level), _down(asked, level)
    stored = materialize(stored, "tiles")
    box = [x for n in names for x in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"))]
    boxes = materialize(stored.groupBy("tile").agg(F.count("*").alias("n"), *box), "boxes")

    # the bound, from a sample of the query's own tile
    thin = stored.join(boxes.select(F.col("tile").alias("of_tile"), "n"), F.col("tile") == F.col("of_tile"))
    thin = thin.where(F.pmod(F.xxhash64(*names), F.ceil(F.col("n") / SAMPLE)) == 0).groupBy("of_tile").agg(F.collect_list(F.array(*names)).alias("near"))

    def kth(distances):
        return F.get(F.array_sort(distances), F.lit(k - 1))

    around = kth(F.transform("near", lambda p: squared(mine, [p[i] for i in range(len(names))])))
    anywhere = kth(F.array(*(squared(mine, [F.lit(float(v)) for v in p]) for p in chosen)))
    asked = asked.join(thin, F.col("tile") == F.col("of_tile"), "left")
    asked = asked.withColumn("bound", F.least(F.coalesce(around, F.lit(float("inf"))), F.coalesce(anywhere, F.lit(float("inf")))))
    asked = materialize(asked.select(*names, (F.col("bound") * (1 + 1e-12) + _SLACK).alias("bound")), "queries")  # ties count as within

    # the tiles whose boxes the bound reaches: down the slabs, by the extent of each in the feature that cuts it
    visited, below = asked.withColumn("tile", top).withColumn("gap", F.lit(0.0)), boxes.withColumn("at", F.col("tile"))
    steps = []
    for name, most, edges in reversed(levels):
        up = F.floor(F.col("at") / most).cast("long")
        steps.append((name, below.groupBy(up.alias("of_tile"), F.col("at").alias("part")).agg(F.min(f"low_{name}").alias("low"), F.max(f"high_{name}").alias("high"))
                      .groupBy("of_tile").agg(F.collect_list(F.struct("part", "low", "high")).alias("parts"))))
        below = below.withColumn("at", up)
    for name, parts in reversed(steps):
        away = F.greatest(F.col("p.low") - F.col(name), F.col(name) - F.col("p.high"), F.lit(0.0))
        visited = visited.join(materialize(parts, "parts"), F.col("tile") == F.col("of_tile")).select(*names, "bound", "gap", F.explode("parts").alias("p"))
        visited = visited.withColumn("gap", F.col("gap") + away * away).where(F.col("gap") <= F.col("bound")).select(*names, "bound", "gap", F.col("p.part").alias("tile"))
    ends = boxes.withColumnRenamed("tile", "of_tile")
    away = [F.greatest(F.col(f"low_{n}") - F.col(n), F.col(n) - F.col(f"high_{n}"), F.lit(0.0)) for n in names]
    visited = visited.join(ends, F.col("tile") == F.col("of_tile")).where(reduce(lambda a, b: a + b, (x * x for x in away)) <= F.col("bound"))

    pairs = visited.select(*names, "bound", "tile").join(
        stored.select("tile", "members", *(F.col(n).alias(f"p{n}") for n in names)), "tile"
    ).where(squared(mine, theirs) <= F.col("bound"))
    pairs = pairs.select(*names, F.array(*theirs).alias("point"), F.round(squared(mine, theirs), DECIMALS).alias("squared_distance"), F.explode("members").alias("m"))
    best = Window.partitionBy(*names).orderBy("squared_distance", "key")
    ranked = pairs.select(*names, "point", "squared_distance", "m.key", "m.value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(*(F.col(n).alias(f) for n, f in zip(names, features)), "key", "value", "point", "squared_distance", "rank")
