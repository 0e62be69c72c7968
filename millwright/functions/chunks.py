"""Per-machine ordered work split into (machine, time chunk) groups.

Partitioning a window by machine alone puts a machine's whole history into one task. Here the unit is
a machine and a fixed span of hours:

* ``over_chunks`` serves frames of known length: each row is also copied into the neighbouring chunk
  that can see it (a halo), windows run inside chunks, and the copies are dropped again.
* ``over_spans`` does the same for rows that each stand for a span of hours: the spans are copied and
  shuffled, their hours are written out inside the chunks.
* ``with_neighbours`` serves unbounded look-back or look-ahead ("last value so far"): every chunk
  publishes its first and last value, a running pass over those few rows carries them across chunks.

All give exactly the result of the machine-wide window.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millwright.functions.columns import epoch_hour

CHUNK_HOURS = 8640
HOUR, CHUNK, HOME = "__hour", "__chunk", "__home"


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Hash chunks over ``spark.sql.shuffle.partitions`` tasks.

    The number is explicit because adaptive execution would merge tasks by their input bytes, while the
    windows after it are heavy on CPU and gap filling multiplies the rows.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, CHUNK)


def over_chunks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    key: str = "machine_id_std",
    time: str = "window_start",
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Run ``build(frame, window)`` where frames reach at most ``back`` hours back and ``ahead`` hours ahead."""
    hour, size = F.col(HOUR), F.lit(chunk_hours)
    copies = F.sequence(F.floor((hour - ahead) / size), F.floor((hour + back) / size))
    rows = (
        df.withColumn(HOUR, epoch_hour(F.col(time)))
        .withColumn(HOME, F.floor(hour / size))
        .withColumn(CHUNK, F.explode(copies))
    )
    done = build(_spread(rows, key), Window.partitionBy(key, CHUNK).orderBy(HOUR))
    return done.filter(F.col(CHUNK) == F.col(HOME)).drop(HOUR, CHUNK, HOME)


def over_spans(
    spans: DataFrame,
    hours: Callable[[DataFrame], DataFrame],
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    key: str = "machine_id_std",
    last: str = "__last",
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """``over_chunks`` for rows that stand for the hours from ``__hour`` to ``last``.

    ``hours`` gets one row for each hour, numbered ``hour``, and must keep ``key``, ``__chunk`` and ``hour``.
    """
    size, chunk = F.lit(chunk_hours), F.col(CHUNK)
    copies = F.sequence(F.floor((F.col(HOUR) - ahead) / size), F.floor((F.col(last) + back) / size))
    rows = _spread(spans.withColumn(CHUNK, F.explode(copies)), key)
    first, end = F.greatest(F.col(HOUR), chunk * size - back), F.least(F.col(last), (chunk + 1) * size + ahead - 1)
    done = build(hours(rows.withColumn("hour", F.explode(F.sequence(first, end)))), Window.partitionBy(key, CHUNK).orderBy("hour"))
    return done.filter(chunk == F.floor(F.col("hour") / size)).drop(CHUNK, "hour")


def with_neighbours(
    df: DataFrame,
    points: Mapping[str, Sequence[str]],
    past_only: Sequence[str] = (),
    key: str = "machine_id_std",
    hour: str = HOUR,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Add the nearest non-null points of each series around every row.

    ``points`` maps a series name to columns that are null together. For series ``p`` the added structs
    hold ``h`` and those columns: ``p__prev`` is the last point at or before the row, ``p__next`` (unless
    in ``past_only``) the first one strictly after it. The (key, hour) pair must be unique.
    """
    point = {
        p: F.when(F.col(cols[0]).isNotNull(), F.struct(F.col(hour).alias("h"), *[F.col(c) for c in cols]))
        for p, cols in points.items()
    }
    forward = [p for p in points if p not in past_only]
    rows = df.filter(F.col(key).isNotNull()).withColumn(CHUNK, F.floor(F.col(hour) / F.lit(chunk_hours)))

    ends = rows.groupBy(key, CHUNK).agg(
        *[F.max(point[p]).alias(f"{p}__last") for p in points],
        *[F.min(point[p]).alias(f"{p}__first") for p in forward],
    )
    whole = Window.partitionBy(key)
    earlier = whole.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        key,
        CHUNK,
        *[F.last(f"{p}__last", ignorenulls=True).over(earlier).alias(f"{p}__before") for p in points],
        *[F.last(f"{p}__first", ignorenulls=True).over(later).alias(f"{p}__after") for p in forward],
    )

    inside = Window.partitionBy(key, CHUNK)
    up = inside.orderBy(hour).rowsBetween(Window.unboundedPreceding, 0)
    # A descending frame, because Spark rescans "current row to unbounded following" for every row.
    down = inside.orderBy(F.desc(hour)).rowsBetween(Window.unboundedPreceding, -1)
    found = {f"{p}__prev": F.coalesce(F.last(point[p], ignorenulls=True).over(up), F.col(f"{p}__before")) for p in points}
    found |= {f"{p}__next": F.coalesce(F.last(point[p], ignorenulls=True).over(down), F.col(f"{p}__after")) for p in forward}
    added = _spread(rows, key).join(carried, [key, CHUNK]).withColumns(found)
    return added.drop(CHUNK, *[f"{p}__before" for p in points], *[f"{p}__after" for p in forward])


def running_total_columns(columns: Sequence[str], w: WindowSpec) -> dict[str, Column]:
    """Running sums read by ``trailing_sum``/``leading_sum``; for non-negative whole numbers only."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return {f"__run_{c}": F.sum(c).over(upto) for c in columns}


def running_totals(df: DataFrame, columns: Sequence[str], w: WindowSpec) -> DataFrame:
    return df.withColumns(running_total_columns(columns, w))


def trailing_sum(column: str, rows: int, w: WindowSpec) -> Column:
    """Sum over the current row and the ``rows - 1`` before it, at O(1) per row whatever the length."""
    run = F.col(f"__run_{column}")
    return run - F.coalesce(F.lag(run, rows).over(w), F.lit(0))


def leading_sum(column: str, first: int, last: int, w: WindowSpec) -> Column:
    """Sum over rows ``first`` to ``last`` ahead of the current one, cut off where the series ends."""
    run = F.col(f"__run_{column}")
    total = F.max(run).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.coalesce(F.lead(run, last).over(w), total)
    if first == 0:
        return upto - run + F.col(column)
    return upto - F.coalesce(F.lead(run, first - 1).over(w), total)


# ---- rolling statistics of 6, 12 and 24 rows by doubling ---------------------------------------
#
# A sliding frame feeds every row of the frame to every aggregate again (42 updates per row and
# statistic for the three lengths together). Instead 3 rows are merged from single rows, 6 from two
# threes, 12 from two sixes, 24 from two twelves: a handful of ``lag`` reads per row. Means and squared
# deviations merge pairwise (Chan et al.), which keeps constant stretches exactly constant; values are
# taken relative to the first one of the chunk, so that a large offset costs no digits.

Blocks = Mapping[str, str]  # column -> "moments" (mean, deviation and max), "max" or "sum"


def _parts(column: str, kind: str) -> list[str]:
    names = {"moments": ["n", "mean", "m2", "max"], "max": ["max"], "sum": ["sum"]}[kind]
    return [f"__{column}_{name}" for name in names]


def _single(x: Column, kind: str, shift: Column) -> list[Column]:
    zero = F.lit(0.0)
    if kind == "moments":
        return [F.when(x.isNotNull(), 1.0).otherwise(0.0), F.coalesce(x - shift, zero), zero, x]
    return [x] if kind == "max" else [F.coalesce(x, F.lit(0))]


def _merge(a: list[Column], b: list[Column], kind: str) -> list[Column]:
    """``b`` may be all null: the rows before the start of a series."""
    if kind == "max":
        return [F.greatest(a[0], b[0])]
    if kind == "sum":
        return [a[0] + F.coalesce(b[0], F.lit(0))]
    nb = F.coalesce(b[0], F.lit(0.0))
    n = a[0] + nb
    delta = F.when(nb == 0, 0.0).otherwise(b[1] - a[1])
    share = F.when(n > 0, nb / n).otherwise(0.0)
    return [
        n,
        a[1] + delta * share,
        a[2] + F.coalesce(b[2], F.lit(0.0)) + delta * delta * a[0] * share,
        F.greatest(a[3], b[3]),
    ]


def block_lags(blocks: Blocks, rows: int, w: WindowSpec) -> dict[str, Column]:
    """Window columns to compute before ``block_level(blocks, rows)``; ``rows`` is 1, 3, 6 or 12."""
    if rows == 1:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        shifts = {f"__{c}_shift": F.first(c, ignorenulls=True).over(whole) for c in blocks if blocks[c] == "moments"}
        return shifts | {f"__{c}_lag{k}": F.lag(c, k).over(w) for c in blocks for k in (1, 2)}
    return {f"{p}{rows}_lag": F.lag(f"{p}{rows}", rows).over(w) for c, kind in blocks.items() for p in _parts(c, kind)}


def block_level(blocks: Blocks, rows: int) -> dict[str, Column]:
    """Statistics of 3 rows (from ``rows=1``) or of twice ``rows``."""
    out = {}
    for c, kind in blocks.items():
        names = _parts(c, kind)
        if rows == 1:
            shift = F.col(f"__{c}_shift")
            one, two, three = (_single(F.col(x), kind, shift) for x in (c, f"__{c}_lag1", f"__{c}_lag2"))
            merged, size = _merge(_merge(one, two, kind), three, kind), 3
        else:
            here, before = ([F.col(f"{p}{rows}{suffix}") for p in names] for suffix in ("", "_lag"))
            merged, size = _merge(here, before, kind), 2 * rows
        out |= {f"{p}{size}": v for p, v in zip(names, merged)}
    return out


def rolling_blocks(df: DataFrame, blocks: Blocks, w: WindowSpec) -> DataFrame:
    for rows in (1, 3, 6, 12):
        df = df.withColumns(block_lags(blocks, rows, w)).withColumns(block_level(blocks, rows))
    return df


def block_mean(column: str, rows: int) -> Column:
    return F.when(F.col(f"__{column}_n{rows}") > 0, F.col(f"__{column}_shift") + F.col(f"__{column}_mean{rows}"))


def block_std(column: str, rows: int) -> Column:
    """Sample deviation, null for fewer than two values."""
    n = F.col(f"__{column}_n{rows}")
    return F.when(n > 1, F.sqrt(F.col(f"__{column}_m2{rows}") / (n - 1)))
