"""Outlier flags. Flags are added, rows are never removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.quantiles import exact_quantiles, medians
from millwright.functions.storage import attach_row, materialize


def _fitted(df: DataFrame, fit: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(fit, list(by), "left") if by else attach_row(df, fit)


def flag_zscore(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """``{c}_z`` and ``{c}_is_outlier`` (|z| above the limit); a constant column has null z and no outliers."""
    fit = df.agg(
        *[F.avg(c).alias(f"__{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"__{c}_std") for c in columns]
    )
    rows = attach_row(df, fit)
    z = {c: (F.col(c) - F.col(f"__{c}_mean")) / F.when(F.col(f"__{c}_std") != 0, F.col(f"__{c}_std")) for c in columns}
    rows = rows.withColumns({f"{c}_z": z[c] for c in columns})
    flags = {f"{c}_is_outlier": F.coalesce(F.abs(F.col(f"{c}_z")) > limit, F.lit(False)) for c in columns}
    return rows.withColumns(flags).select(*df.columns, *[n for c in columns for n in (f"{c}_z", f"{c}_is_outlier")])


def flag_iqr(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """``{c}_low``, ``{c}_high`` fences and ``{c}_is_iqr_outlier``, over all rows or per group."""
    fit = exact_quantiles(df, columns, [0.25, 0.75], by)
    rows, added = _fitted(df, fit, by), {}
    for c in columns:
        q1, q3 = F.col(f"{c}_q0"), F.col(f"{c}_q1")
        low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        added |= {
            f"{c}_low": low,
            f"{c}_high": high,
            f"{c}_is_iqr_outlier": F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False)),
        }
    return rows.withColumns(added).select(*df.columns, *added)


def iqr_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Fences only, one row per group."""
    fit = exact_quantiles(df, columns, [0.25, 0.75], by)
    out: list[Column] = []
    for c in columns:
        q1, q3 = F.col(f"{c}_q0"), F.col(f"{c}_q1")
        out += [(q1 - k * (q3 - q1)).alias(f"{c}_low"), (q3 + k * (q3 - q1)).alias(f"{c}_high")]
    return fit.select(*by, *out)


def flag_robust_z(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), limit: float = 3.5, scale: float = 0.6745
) -> DataFrame:
    """``{c}_robust_z`` from median and MAD and its flag; with MAD 0 the score is null and
    ``{c}_mad_is_zero`` tells so."""
    # Written, because the deviations below and the final scores both build on it.
    mid = materialize(medians(df, columns, by), "medians").select(*by, *[F.col(c).alias(f"__{c}_med") for c in columns])
    rows = _fitted(df, mid, by)
    spread = rows.select(*by, *[F.abs(F.col(c) - F.col(f"__{c}_med")).alias(c) for c in columns])
    mad = medians(spread, columns, by).select(*by, *[F.col(c).alias(f"__{c}_mad") for c in columns])
    rows, added = _fitted(rows, mad, by), {}
    for c in columns:
        width = F.col(f"__{c}_mad")
        z = scale * (F.col(c) - F.col(f"__{c}_med")) / F.when(width != 0, width)
        added |= {
            f"{c}_robust_z": z,
            f"{c}_is_robust_outlier": F.coalesce(F.abs(z) > limit, F.lit(False)),
            f"{c}_mad_is_zero": F.coalesce(width == 0, F.lit(False)),
        }
    return rows.withColumns(added).select(*df.columns, *added)


def outlier_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Count and share per flag column."""
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])
    cells = [F.struct(F.lit(f).alias("flag"), F.col(f).alias("outliers")) for f in flags]
    return wide.select("__n", F.explode(F.array(*cells)).alias("c")).select(
        "c.flag", "c.outliers", F.expr("try_divide(c.outliers, __n)").alias("share")
    )


def outliers_per_group(df: DataFrame, flags: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count(F.when(F.col(f), 1)).alias(f) for f in flags])


def compare_methods(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows flagged by either method; ``priority`` is high when both agree."""
    both = F.col(first) & F.col(second)
    return df.filter(F.col(first) | F.col(second)).withColumn(
        "priority", F.when(both, "high").otherwise("review")
    )


def before_after(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, deviation, min and max of each column before and after a correction."""
    frames = []
    for stage, frame in (("before", before), ("after", after)):
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
        long = frame.select(F.explode(pairs).alias("p")).select("p.*")
        frames.append(
            long.groupBy("column").agg(
                F.count("x").alias("n"), F.count(F.when(F.col("x").isNull(), 1)).alias("nulls"), F.avg("x").alias("mean"),
                F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
            ).withColumn("stage", F.lit(stage))
        )
    return frames[0].unionByName(frames[1])


def correct(df: DataFrame, column: str, corrected: Column, old: str = "old_value") -> DataFrame:
    """Replace a column and keep its former value beside it, which is what ``correction_log`` reads."""
    return df.withColumns({old: F.col(column), column: corrected})


def correction_log(corrected: DataFrame, keys: Sequence[str], column: str, old: str = "old_value") -> DataFrame:
    """Rows of a corrected frame whose value changed, with old and new value; repeated and null keys are all kept."""
    changed = corrected.filter(~F.col(old).eqNullSafe(F.col(column)))
    return changed.select(*keys, F.col(old).alias("old_value"), F.col(column).alias("new_value"))
