"""Connected components by alternating star contractions, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.storage import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component), the smallest node of its component, for every node with an edge.

    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours likewise;
    the number of rounds grows with the logarithm of the longest path. A round is written to the shared folder,
    so its lineage is one scan. Nothing but a count and a checksum reaches the driver. Null ends and loops are
    ignored; repeated edges count once; no edges give no rows.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("m"))
        large = (
            both.join(least, "high").where("low > high")
            .select(F.col("low").alias("high"), F.least("m", "high").alias("low")).distinct()
        )
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        ends = F.explode(F.array("high", "low")).alias("high")
        now = materialize(large.join(least, "high").select(ends, F.col("m").alias("low")).where("high <> low").distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    stars = now.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
