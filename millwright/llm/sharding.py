"""Shards of nearly equal bytes: contiguous runs of atomic groups with the smallest possible largest shard.

Groups (equal texts) stand in the order of their digests. The smallest capacity for which a greedy filling needs no
more than the given number of shards is searched by bisection; a greedy filling is one look-up of running totals per
shard, done for many capacities at a time. The result is a list of cut digests, so rows find their shard by comparing
digests with literals: no join, and a group that holds a third of all rows is spread like any other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.storage import materialize

#: Capacities tried by each pass over the running totals.
TRIALS = 16
#: Digests are numbered inside this many ranges of their first digits; a range is one window.
DIGEST_DIGITS = 3
#: Rows of a shard are numbered inside this many parts.
SLOT_PARTS = 1024


def running_totals(rows: DataFrame) -> DataFrame:
    """(digest, size) rows -> (digest, size, upto): each group's size and the total up to and with it, in digest order.

    Digests are spread evenly, so ranges of them are of equal length; only the ranges' sums pass a single task.
    """
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).withColumn("range", F.substring("digest", 1, DIGEST_DIGITS))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = groups.groupBy("range").agg(F.sum("size").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return groups.withColumn("within", F.sum("size").over(inside)).join(F.broadcast(ranges), "range").select(
        "digest", "size", (F.col("base") + F.col("within")).alias("upto")
    )


def _ends(totals: DataFrame, limits: list[int]) -> list[int]:
    """For each limit the largest running total that does not pass it; zero if even the first does."""
    at_most = [F.max(F.when(F.col("upto") <= x, F.col("upto"))) for x in limits]
    return [x or 0 for x in totals.where(F.col("upto") <= max(limits)).agg(*at_most).first()]


def smallest_capacity(totals: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, end of each shard but the last as a running total); zero capacity for an empty table."""
    whole, largest = totals.agg(F.max("upto"), F.max("size")).first()
    if whole is None:
        return 0, [0] * (shards - 1)

    def filled(capacities):
        ends = [[0] * len(capacities)]
        for _ in range(shards - 1):
            ends.append(_ends(totals, [e + c for e, c in zip(ends[-1], capacities)]))
        return [([e[k] for e in ends[1:]], ends[-1][k] + c >= whole) for k, c in enumerate(capacities)]

    low, high = max(-(-whole // shards), largest), -(-whole // shards) + largest
    cuts = None
    while low < high or cuts is None:
        step = max(1, (high - low) // (TRIALS - 1))
        tried = sorted({*range(low, high, step), high})
        for capacity, (ends, enough) in zip(tried, filled(tried)):
            if enough:
                high, cuts = capacity, ends
                break
            low = capacity + 1
    return high, cuts


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row of ``docs``: equal texts in one shard, bytes nearly equal.

    ``size`` is the text's UTF-8 bytes plus one (null: one). The largest shard is the smallest that any cutting of the
    groups in digest order allows; a shard can stay empty if one group outweighs an even share. Slots run from 0
    without gaps in each shard, by id hash and id; rows that are equal in both are interchangeable. Null ids are
    numbered like others; null and empty texts differ only in name: both have no bytes and form one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest"),
    )
    rows = materialize(rows, "shard-rows")
    totals = materialize(running_totals(rows), "shard-totals")
    _, ends = smallest_capacity(totals, shards)
    wanted = [e for e in ends if e]
    cuts = {r["upto"]: r["digest"] for r in totals.where(F.col("upto").isin(wanted)).collect()} if wanted else {}
    number = F.lit(0)
    for e in ends:
        number = number + (F.col("digest") > cuts.get(e, "")).cast("int")
    placed = rows.withColumn("shard", number).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SLOT_PARTS)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(
        "shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("shard", "part").orderBy("id", "digest")
    return (
        placed.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(parts), ["shard", "part"])
        .select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"))
    )
