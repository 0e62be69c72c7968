"""Exact quantiles (linear interpolation) without gathering values.

``percentile``/``median`` keep every distinct value of a group in one hash map, which a continuous signal on a hot
machine outgrows. Here a sketch first brackets each wanted rank. A second pass counts what lies below, on and above the
bracket's ends, in salted partials, so a hot group is many tasks; what lies strictly inside, a share of about
``4 / accuracy`` of the group, is counted by distinct value, and a running count finds the rank. No step builds an array
or a hash map of a group's values: sorts spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.storage import attach_row, materialize

#: Tasks that share the counting of a group.
SALTS = 16
#: Types of the columns that a salt may hang on.
SALT_TYPES = ("timestamp", "timestamp_ntz", "date", "bigint", "int")
#: Groups up to this many have their bracket ends broadcast: a row of numbers each.
BROADCAST_GROUPS = 2000


def row_salt(df: DataFrame, columns: Sequence[str]) -> Column:
    """A salt that differs between rows of equal values: with the first three other columns that are times or whole numbers.

    A sensor that reads the same all the time is spread by its timestamps. The salt hangs on nothing but the row, so a
    task that runs again deals its rows alike.
    """
    other = [c for c, t in df.dtypes if c not in columns and t in SALT_TYPES]
    return F.pmod(F.xxhash64(*columns, *other[:3]), F.lit(SALTS))


def _ends(c: str, i: int) -> tuple[Column, Column]:
    return F.col(f"__{c}_ends")[2 * i], F.col(f"__{c}_ends")[2 * i + 1]


def _bracketed(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: list[str], accuracy: int) -> DataFrame:
    """Rows with the bracket ends of their group, and a salt."""
    eps = 2.0 / accuracy
    ends = [e for p in probs for e in (max(0.0, p - eps), min(1.0, p + eps))]
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns], row_salt(df, [*columns]).alias("__salt"))
    for key in by:
        rows = rows.filter(F.col(key).isNotNull())
    sketch = rows.groupBy(*by).agg(*[F.percentile_approx(c, ends, accuracy).alias(f"__{c}_ends") for c in columns])
    if not by:
        return attach_row(rows, sketch)
    return with_group_row(rows, sketch, by)


def with_group_row(rows: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, which carry a ``__salt``, with the one row of their group."""
    groups = materialize(groups, "groups")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), list(by))  # few groups are hot groups: their rows stay where they are
    # a group's row goes to every part of its group, so the join is spread as the counting is; never broadcast, as Spark
    # would judge by the stored file, which is many times smaller than the copies are in the driver's memory
    salted = groups.withColumn("__salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    return rows.join(salted.hint("merge"), [*by, "__salt"])


def _pick(k: Column, part: dict[str, Column]) -> Column:
    """The value of 0-based rank ``k``, which lies in the bracket or is its direct neighbour; null if strictly inside."""
    at_hi = F.when(part["lo"] == part["hi"], 0).otherwise(part["at_hi"])
    inside = k - part["below"] - part["at_lo"]
    past = inside - part["n_mid"] - at_hi
    wrong = F.raise_error(F.lit("rank fell outside its sketch bracket")).cast("double")
    return (
        F.when(k < part["below"] - 1, wrong)
        .when(k < part["below"], part["under"])
        .when(inside < 0, part["lo"])
        .when(inside < part["n_mid"], F.lit(None).cast("double"))
        .when(past < 0, part["hi"])
        .when(past == 0, part["above"])
        .otherwise(wrong)
    )


def quantiles_long(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 50_000,
) -> DataFrame:
    """One row per group and column: ``column``, ``n`` and ``q0..`` (groups without a value give no row)."""
    by, columns = list(by), list(columns)
    rows = _bracketed(df, columns, probs, by, accuracy)
    merge = {"n": F.sum, "below": F.sum, "at_lo": F.sum, "at_hi": F.sum, "n_mid": F.sum, "under": F.max, "above": F.min}
    first, second, cells = [], [], []
    for c in columns:
        x = F.col(c)
        first += [F.count(x).alias(f"{c}__n"), F.first(f"__{c}_ends").alias(f"{c}__ends")]
        second += [F.sum(f"{c}__n").alias(f"{c}__n"), F.first(f"{c}__ends", ignorenulls=True).alias(f"{c}__ends")]
        for i in range(len(probs)):
            lo, hi = _ends(c, i)
            parts = {
                "below": F.count(F.when(x < lo, 1)), "at_lo": F.count(F.when(x == lo, 1)), "at_hi": F.count(F.when(x == hi, 1)),
                "n_mid": F.count(F.when((x > lo) & (x < hi), 1)), "under": F.max(F.when(x < lo, x)), "above": F.min(F.when(x > hi, x)),
            }
            first += [agg.alias(f"{c}__{name}{i}") for name, agg in parts.items()]
            second += [merge[name](f"{c}__{name}{i}").alias(f"{c}__{name}{i}") for name in parts]
            cells.append(F.when((x > lo) & (x < hi), F.struct(F.lit(c).alias("column"), F.lit(i).alias("i"), x.alias("x"))))
    counted = rows.groupBy(*by, "__salt").agg(*first).groupBy(*by).agg(*second)
    names = ["n", "ends", *(f"{name}{i}" for i in range(len(probs)) for name in merge if name != "n")]
    table = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n in names]) for c in columns])
    counted = counted.select(*by, F.explode(table).alias("t")).select(*by, "t.*").filter(F.col("n") > 0)

    # strictly inside: distinct values, their counts, and the ranks they cover
    keys = [*by, "column"]
    inside = rows.select(*by, F.explode(F.array_compact(F.array(*cells))).alias("v")).select(*by, "v.*")
    values = inside.groupBy(*keys, "i", "x").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(*keys, "i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.sum("k").over(upto))
    wanted = counted.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("n") - 1)).alias("pos"), (F.col(f"below{i}") + F.col(f"at_lo{i}")).alias("skip"))
        for i, p in enumerate(probs)
    ])).alias("w")).select(*keys, "w.*")
    placed = values.join(wanted, [*keys, "i"])
    covers = lambda rank: (rank - F.col("skip") >= F.col("upto") - F.col("k")) & (rank - F.col("skip") < F.col("upto"))
    low_hit, high_hit = covers(F.floor("pos")), covers(F.ceil("pos"))
    found = placed.where(low_hit | high_hit).groupBy(*keys).agg(*[
        F.max(F.when((F.col("i") == i) & hit, F.col("x"))).alias(f"{name}{i}")
        for i in range(len(probs)) for name, hit in (("low", low_hit), ("high", high_hit))
    ])
    both = counted.join(found, keys, "left")
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        part = {name: F.col(f"{name}{i}") for name in merge if name != "n"}
        part["lo"], part["hi"] = F.col("ends")[2 * i], F.col("ends")[2 * i + 1]
        low = F.coalesce(_pick(F.floor(pos), part), F.col(f"low{i}"))
        high = F.coalesce(_pick(F.ceil(pos), part), F.col(f"high{i}"))
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return both.select(*keys, "n", *out)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 50_000,
) -> DataFrame:
    """One row per group with ``{column}_q{i}`` for each probability; null where a group has no value."""
    found = quantiles_long(df, columns, probs, by, accuracy)
    wide = [
        F.max(F.when(F.col("column") == c, F.col(f"q{i}"))).alias(f"{c}_q{i}")
        for c in columns
        for i in range(len(probs))
    ]
    return found.groupBy(*by).agg(*wide)


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), accuracy: int = 50_000) -> DataFrame:
    """Exact median per column, under the column's own name."""
    found = exact_quantiles(df, columns, [0.5], by, accuracy)
    return found.select(*by, *[F.col(f"{c}_q0").alias(c) for c in columns])
