"""Filling missing values: gap interpolation on the hourly grid and general fit/apply strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.chunks import CHUNK_HOURS, HOUR, with_neighbours
from millwright.functions.columns import epoch_hour
from millwright.functions.quantiles import SALT_TYPES, medians
from millwright.functions.neighbours import nearest
from millwright.functions.storage import attach_row, materialize
from millwright.schemas import HOURLY_COLUMNS, PIECES

#: Passes of the regression strategy.
REGRESSION_ROUNDS = 2


def interpolated(column: str, hour: Column, fallback: Column, causal: bool = False, series: str | None = None) -> Column:
    """Linear between the surrounding values, nearest value beyond the ends, then the fallback.

    ``causal`` uses past values only; ``series`` names the neighbour series when it is not the column.
    """
    before = F.col(f"{series or column}__prev")
    if causal:
        return F.coalesce(before[column], fallback)
    after = F.col(f"{series or column}__next")
    slope = (after[column] - before[column]) / (after["h"] - before["h"])
    return F.coalesce(before[column] + slope * (hour - before["h"]), before[column], after[column], fallback)


def train_medians(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Exact medians of the training rows, one row, columns named ``{column}__median``.

    The rows that hold a value are written once, as the quantiles read them three times; the rest of a sparse grid is
    left behind. Times and whole numbers stay, for the salt.
    """
    held = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    other = [c for c, t in df.dtypes if c not in columns and t in SALT_TYPES]
    fitted = medians(materialize(df.filter(train & held).select(*columns, *other[:3]), "training-rows"), columns)
    return fitted.select(*[F.col(c).alias(f"{c}__median") for c in columns])


def impute_hourly_signals(
    grid: DataFrame,
    columns: Sequence[str] = tuple(HOURLY_COLUMNS),
    clip: Sequence[str] = (PIECES,),
    causal: bool = False,
    chunk_hours: int = CHUNK_HOURS,
) -> DataFrame:
    """Interpolate each machine's gaps; a machine without any value takes the training median.

    Medians come from the observed training rows, before any filling. The grid is read four times, so it
    is written once first. An hour's mean and maximum of a signal are missing together, so they share one neighbour
    search.
    """
    series, of = {}, {}
    for c in columns:
        of[c] = c.replace("_max_1h", "_mean_1h") if c.replace("_max_1h", "_mean_1h") in columns else c
        series.setdefault(of[c], []).append(c)
    grid = materialize(grid, "grid")
    fitted = train_medians(grid, columns, F.col("split_set") == "train")
    keyed = grid.withColumn(HOUR, epoch_hour(F.col("window_start")))
    rows = with_neighbours(keyed, series, list(series) if causal else (), chunk_hours=chunk_hours)
    rows = attach_row(rows, fitted)
    filled = {}
    for c in columns:
        value = interpolated(c, F.col(HOUR), F.col(f"{c}__median"), causal, of[c])
        filled[c] = F.greatest(value, F.lit(0.0)) if c in clip else value
    return rows.withColumns(filled).select(*grid.columns)


def drop_sparse_rows(df: DataFrame, min_present: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with fewer than ``min_present`` non-null values."""
    return df.na.drop(thresh=min_present, subset=list(columns) if columns else None)


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def flag_from_comment(df: DataFrame, word_to_flag: Mapping[str, str], comment: str = "comment") -> DataFrame:
    """Set a flag to 1 where the comment contains the word, whatever its case; null comments change nothing."""
    text = F.lower(F.coalesce(F.col(comment), F.lit("")))
    return df.withColumns(
        {flag: F.when(text.contains(word.lower()), 1).otherwise(F.col(flag)) for word, flag in word_to_flag.items()}
    )


def fit_statistics(df: DataFrame, columns: Sequence[str], strategy: str, train: Column | None = None) -> DataFrame:
    """One row of per-column fill values fitted on the training rows only."""
    rows = df if train is None else df.filter(train)
    if strategy == "mean":
        return rows.agg(*[F.avg(c).alias(f"{c}__fit") for c in columns])
    if strategy == "median":
        fitted = medians(rows, columns)
        return fitted.select(*[F.col(c).alias(f"{c}__fit") for c in columns])
    raise ValueError(f"strategy must be mean or median, not {strategy!r}")


def apply_statistics(df: DataFrame, fitted: DataFrame, columns: Sequence[str], mark: bool = False) -> DataFrame:
    """Fill nulls with fitted values; ``mark`` adds ``{column}_was_imputed``."""
    rows = attach_row(df, fitted)
    added = {f"{c}_was_imputed": F.col(c).isNull() for c in columns} if mark else {}
    filled = {c: F.coalesce(F.col(c), F.col(f"{c}__fit")) for c in columns}
    return rows.withColumns(added).withColumns(filled).select(*df.columns, *added)


def impute_statistic(
    df: DataFrame, columns: Sequence[str], strategy: str, train: Column | None = None, mark: bool = False
) -> DataFrame:
    """Fit on train, apply everywhere."""
    return apply_statistics(df, fit_statistics(df, columns, strategy, train), columns, mark)


def compare_strategies(grid: DataFrame, columns: Sequence[str], mask: Column, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Hide known training values, refill them, report the mean absolute error per signal and strategy.

    ``mask`` picks the hidden rows and must be a rule on keys (a hash), so both sides see the same rows.
    Strategies: ``interpolation``, ``median`` and ``regression`` (fitted on the training rows left visible).
    """
    train = F.col("split_set") == "train"
    hidden = mask & train
    rows = materialize(grid, "grid").withColumn("__hidden", hidden).withColumn(HOUR, epoch_hour(F.col("window_start")))
    masked = rows.withColumns({c: F.when(~F.col("__hidden"), F.col(c)) for c in columns})
    truth = rows.withColumns(
        {
            **{f"{c}__true": F.when(F.col("__hidden"), F.col(c)) for c in columns},
            **{c: F.when(~F.col("__hidden"), F.col(c)) for c in columns},
        }
    )
    fitted = train_medians(masked, columns, train)
    guessed = impute_regression(truth.withColumns({f"{c}__line": F.col(c) for c in columns}), [f"{c}__line" for c in columns], train, REGRESSION_ROUNDS)
    filled = attach_row(with_neighbours(guessed, {c: [c] for c in columns}, chunk_hours=chunk_hours), fitted)
    errors = []
    for c in columns:
        between = interpolated(c, F.col(HOUR), F.col(f"{c}__median"))
        for strategy, value in (("interpolation", between), ("median", F.col(f"{c}__median")), ("regression", F.col(f"{c}__line"))):
            errors.append(
                F.struct(
                    F.lit(c).alias("signal"), F.lit(strategy).alias("strategy"),
                    F.abs(value - F.col(f"{c}__true")).alias("error"),
                )
            )
    long = filled.filter(reduce(lambda a, b: a | b, [F.col(f"{c}__true").isNotNull() for c in columns]))
    long = long.select(F.explode(F.array(*errors)).alias("e")).select("e.*")
    return long.groupBy("signal", "strategy").agg(F.avg("error").alias("mean_abs_error"), F.count("error").alias("n_masked"))


def best_strategy(comparison: DataFrame) -> DataFrame:
    """The strategy with the lowest error per signal, ties by name."""
    return comparison.groupBy("signal").agg(
        F.min_by("strategy", F.struct("mean_abs_error", "strategy")).alias("strategy"),
        F.min("mean_abs_error").alias("mean_abs_error"),
    )


def impute_by_strategy(grid: DataFrame, strategies: Mapping[str, str], chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Fill every signal of the hourly grid by the strategy named for it, fitted on training rows.

    ``strategies`` maps signals to ``interpolation``, ``median`` or ``regression``, as ``best_strategy`` finds them.
    """
    columns, train = list(strategies), F.col("split_set") == "train"
    rows = materialize(grid, "grid").withColumn(HOUR, epoch_hour(F.col("window_start")))
    fitted = train_medians(rows, columns, train)
    guessed = impute_regression(rows.withColumns({f"{c}__line": F.col(c) for c in columns}), [f"{c}__line" for c in columns], train, REGRESSION_ROUNDS)
    filled = attach_row(with_neighbours(guessed, {c: [c] for c in columns}, chunk_hours=chunk_hours), fitted)
    value = {}
    for c, strategy in strategies.items():
        median = F.col(f"{c}__median")
        choices = {"interpolation": interpolated(c, F.col(HOUR), median), "median": median, "regression": F.col(f"{c}__line")}
        value[c] = F.coalesce(F.col(c), choices[strategy])
    return filled.withColumns(value).select(*grid.columns)


def _fitted_lines(work: DataFrame, columns: Sequence[str], train: Column | None) -> dict[str, Column]:
    """For each column its least-squares line over the others, from one aggregation of means and covariances.

    Fitted on training rows where the column was observed. Columns that vary with nothing get a zero weight (the
    solution of least norm); a column that was never observed has no line.
    """
    aggs = []
    for t in columns:
        use = F.col(f"{t}__seen") if train is None else F.col(f"{t}__seen") & train
        part = [F.when(use, F.col(c)) for c in columns]
        aggs += [F.avg(x).alias(f"{t}|{i}") for i, x in enumerate(part)]
        aggs += [F.covar_pop(part[i], part[j]).alias(f"{t}|{i}|{j}") for i in range(len(columns)) for j in range(i + 1)]
    found, lines = work.agg(*aggs).first().asDict(), {}
    for k, t in enumerate(columns):
        if found[f"{t}|{k}"] is None:
            continue
        others = [i for i in range(len(columns)) if i != k and found[f"{t}|{i}"] is not None]
        shared = lambda i, j: found[f"{t}|{max(i, j)}|{min(i, j)}"] or 0.0  # noqa: B023, E731
        matrix = np.array([[shared(i, j) for j in others] for i in others]).reshape(len(others), len(others))
        weights = np.linalg.lstsq(matrix, np.array([shared(i, k) for i in others]), rcond=None)[0] if others else []
        start = found[f"{t}|{k}"] - sum(w * found[f"{t}|{i}"] for w, i in zip(weights, others))
        terms = [F.lit(float(w)) * F.col(columns[i]) for w, i in zip(weights, others)]
        lines[t] = reduce(lambda x, y: x + y, terms, F.lit(float(start)))
    return lines


def impute_regression(df: DataFrame, columns: Sequence[str], train: Column | None = None, rounds: int = 3) -> DataFrame:
    """Fill each column from the others by linear regression fitted on training rows, in ``rounds`` passes.

    The first pass starts from training medians; a pass fits all columns on the values the pass before it left. Only
    rows where the target was observed are fitted on; observed values are never changed; a column without a training
    value stays as it is. A pass is one aggregation and column arithmetic; its table is written once.
    """
    columns = list(columns)
    seen = df.withColumns({f"{c}__seen": F.col(c).isNotNull() for c in columns})
    work = apply_statistics(seen, fit_statistics(df, columns, "median", train), columns)
    for _ in range(rounds):
        work = materialize(work, "regression-round")
        lines = _fitted_lines(work, columns, train)
        work = work.withColumns({c: F.when(F.col(f"{c}__seen"), F.col(c)).otherwise(line) for c, line in lines.items()})
    return work.select(*df.columns)


def impute_knn(df: DataFrame, columns: Sequence[str], key: str, k: int = 5, train: Column | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Fill each of ``columns`` by the mean of the ``k`` nearest training rows that have it.

    Distances are Euclidean over the other ``features`` (default: ``columns``), each divided by its training standard
    deviation; a missing feature counts as its training mean. Ties go to the smaller ``key``, which is unique. Rows to
    fill that agree in all features are one query. Observed values stay; without a donor a value stays null.
    """
    features = list(features or columns)
    rows = materialize(df, "knn-rows") if train is None else materialize(df.withColumn("__train", train), "knn-rows")
    donors = rows if train is None else rows.where("__train")
    stats = donors.agg(*(F.avg(c).alias(f"{c}|mean") for c in features), *(F.stddev_samp(c).alias(f"{c}|std") for c in features)).first()
    filled = rows
    for c in columns:
        others = [f for f in features if f != c and stats[f"{f}|mean"] is not None]
        scaled = {f"__z{i}": F.coalesce(F.col(f).cast("double"), F.lit(stats[f"{f}|mean"])) / F.lit(float(stats[f"{f}|std"] or 1.0)) for i, f in enumerate(others)}
        if not scaled:
            raise ValueError(f"{c} has no other feature to measure distances by")
        near = nearest(
            rows.where(F.col(c).isNull()).withColumns(scaled), donors.where(F.col(c).isNotNull()).withColumns(scaled), list(scaled), key, k, value=c
        )
        means = near.groupBy(*scaled).agg(F.avg("value").alias("__mean")).withColumnsRenamed({z: f"{z}q" for z in scaled})
        same = reduce(lambda a, b: a & b, (F.col(z) == F.col(f"{z}q") for z in scaled))
        # only the rows to fill take part in the join, so that no vector of observed rows can be its hot key
        lacking = rows.where(F.col(c).isNull()).withColumns(scaled).join(means, same, "left").select(F.col(key).alias("__key"), "__mean")
        filled = filled.join(lacking, F.col(key) == F.col("__key"), "left").withColumn(c, F.coalesce(F.col(c), F.col("__mean"))).drop("__key", "__mean")
    return filled.select(*df.columns)
