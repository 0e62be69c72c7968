"""Near-duplicate candidates. The operators only propose rows; the rule for removing them stays with the user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.storage import materialize


def near_in_time(
    df: DataFrame, block: Sequence[str], time: str, key: str, max_gap_seconds: int, text: str | None = None
) -> DataFrame:
    """Rows that follow another row of the same block within the gap, with ``previous_id``, ``gap_seconds``
    and, for a text column, the edit distance to the previous text.

    One candidate per row, not all pairs: chains of close rows stay linked through their neighbours.
    Blocks are cut into spans of time; a row near the end of a span is also shown to the next one, so a
    hot block spreads over tasks and no link is lost. Rows without a time, or with a null among the block's
    columns, belong to no block and are linked to nothing.
    """
    at = F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time] == "timestamp" else _micros(time)
    gap, span = max_gap_seconds * 1_000_000, max(max_gap_seconds, 86_400) * 1_000_000
    keep = [*block, key, time, *([text] if text else [])]
    rows = df.na.drop(subset=[time, *block]).select(*keep, at.alias("__at"))
    rows = rows.withColumn("__home", F.floor(F.col("__at") / span)).withColumn(
        "__span", F.explode(F.sequence(F.col("__home"), F.floor((F.col("__at") + gap) / span)))
    )
    w = Window.partitionBy(*block, "__span").orderBy("__at", key)
    added = {"previous_id": F.lag(key).over(w), "__gap": F.col("__at") - F.lag("__at").over(w)}
    if text:
        added["previous_text"] = F.lag(text).over(w)
    linked = rows.withColumns(added).filter((F.col("__span") == F.col("__home")) & (F.col("__gap") <= gap))
    linked = linked.withColumn("gap_seconds", F.col("__gap") / 1_000_000.0)
    if text:
        linked = linked.withColumn("text_distance", F.levenshtein(F.col(text), F.col("previous_text")))
    return linked.drop("__at", "__home", "__span", "__gap")


def _micros(time: str):
    """Microseconds of a naive timestamp, whatever the session time zone."""
    ts = F.col(time)
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    return seconds * 1_000_000 + F.date_format(ts, "SSSSSS").cast("long")


def text_classes(df: DataFrame, block: Sequence[str], key: str, text: str) -> DataFrame:
    """(block, key, text, representative): every row's lower-case text and the smallest key that has it in the block.

    Rows without a text, or with a null among the block's columns, belong to no class.
    """
    rows = df.na.drop(subset=[text, *block]).select(*block, key, F.lower(text).alias("text"))
    first = rows.groupBy(*block, "text").agg(F.min(key).alias("representative"))
    first = first.withColumnsRenamed({c: f"__{c}" for c in [*block, "text"]})
    same = [F.col(c) == F.col(f"__{c}") for c in [*block, "text"]]
    return rows.join(first, same).select(*block, key, "text", "representative")


def near_in_text(df: DataFrame, block: Sequence[str], key: str, text: str, similarity: float = 0.8, shingle: int = 3) -> DataFrame:
    """(block, representative, other, similarity): all pairs of different texts of a block whose shingle sets are alike.

    A shingle is ``shingle`` characters of the lower-case text (the whole of a shorter one), likeness their Jaccard
    coefficient. Texts are compared once, by the smallest key that has them (``text_classes``). Shingles stand in the
    order of how many texts have them, rarest first: two sets can only be alike if they share one of the first few,
    so these are joined, with the bounds that sizes and places set, and what remains is compared exactly. A shingle
    that most texts have comes last and so is hardly ever joined on; nothing is lost and no pairs of a block are made.
    """
    grams = F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text") - shingle + 1, F.lit(1))), lambda i: F.substring("text", i, shingle)))
    rows = df.na.drop(subset=[text, *block]).select(*block, key, F.lower(text).alias("text"))
    texts = rows.groupBy(*block, "text").agg(F.min(key).alias("id")).select(*block, "id", grams.alias("grams"))
    texts = materialize(texts, "text-grams")
    single = texts.select("id", F.explode("grams").alias("gram"))
    having = materialize(single.groupBy("gram").agg(F.count("*").alias("texts")), "gram-counts")
    ordered = single.join(having, "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("texts", "gram"))).alias("order"))
    n = F.size("order")
    first = n - F.ceil(F.lit(similarity) * n - 1e-9) + 1
    prefix = texts.select("id", *block).join(
        ordered.select("id", n.alias("n"), F.posexplode(F.slice("order", F.lit(1), first.cast("int"))).alias("place", "x")), "id"
    ).select(*block, "id", "n", "place", F.col("x.gram").alias("gram"))
    prefix = materialize(prefix, "gram-prefixes")
    left, right = (prefix.select(*(F.col(c).alias(c if c in (*block, "gram") else f"{c}_{s}") for c in prefix.columns)) for s in "xy")
    shared = F.lit(1) + F.least(F.col("n_x") - F.col("place_x") - 1, F.col("n_y") - F.col("place_y") - 1)
    needed = F.lit(similarity / (1 + similarity)) * (F.col("n_x") + F.col("n_y")) - 1e-9
    sizes = F.least("n_x", "n_y") >= F.lit(similarity) * F.greatest("n_x", "n_y") - 1e-9
    pairs = left.join(right, [*block, "gram"]).where((F.col("id_x") < F.col("id_y")) & sizes & (shared >= needed)).select(*block, "id_x", "id_y").distinct()
    sets = [texts.select(F.col("id").alias(f"id_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "xy"]
    both = pairs.join(sets[0], "id_x").join(sets[1], "id_y")
    common = F.size(F.array_intersect("grams_x", "grams_y"))
    alike = common / (F.size("grams_x") + F.size("grams_y") - common)
    return both.select(*block, F.col("id_x").alias("representative"), F.col("id_y").alias("other"), alike.alias("similarity")).where(
        F.col("similarity") >= similarity - 1e-9)

