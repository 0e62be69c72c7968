"""Mergeable states: distinct counts and quantiles of any span from small stored sketches, without reading rows again.

States are kept per group and day (or whatever grain the caller names). A span is answered by merging its states, so
refitting a week costs a few kilobytes a day, and late data add one more state of their day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct-count state: its standard error is 1.04 / sqrt(2 ** this), 1.6 %.
HLL_BITS = 12
#: Size of a quantile state: ranks are right to about 1 / this, doubled for safety in ``RANK_ERROR``.
KLL_SIZE = 400
RANK_ERROR = 2 * 2.296 / KLL_SIZE**0.9


def distinct_states(df: DataFrame, by: Sequence[str], item: str, bits: int = HLL_BITS) -> DataFrame:
    """(by, state): one state of distinct ``item`` values per group; nulls are not counted."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(item, bits).alias("state"))


def merged_distinct(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_distinct): the estimate over all states of a coarser group."""
    return states.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("n_distinct"))


def quantile_states(df: DataFrame, by: Sequence[str], columns: Sequence[str], size: int = KLL_SIZE) -> DataFrame:
    """(by, signal, state): one state per group and signal, made in one pass and merged where the rows lie."""
    kept = [F.kll_sketch_agg_double(F.col(c).cast("double"), size).alias(c) for c in columns]
    wide = df.groupBy(*by).agg(*kept)
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).alias("state")) for c in columns))).alias("x")
    return wide.select(*by, long).select(*by, "x.*").where("state IS NOT NULL")


def merged_quantiles(states: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, signal, n, quantiles): the values at ``shares`` over all states of a coarser group; none where n is zero."""
    merged = states.groupBy(*by, "signal").agg(F.kll_merge_agg_double("state").alias("state"))
    n = F.kll_sketch_get_n_double("state")
    found = F.array(*(F.kll_sketch_get_quantile_double("state", F.lit(float(s))) for s in shares))
    return merged.select(*by, "signal", n.alias("n"), F.when(n > 0, found).alias("quantiles"))
