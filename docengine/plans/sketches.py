"""Mergeable summaries of batches: distinct counts (HyperLogLog) and quantiles (KLL) that are stored once a batch and merged over any set of batches.

A batch's sketch has a fixed size whatever its rows, so a report over a year reads a few kilobytes a batch and none of its rows. Distinct counts
have a relative standard error of 1.04 / sqrt(2**PRECISION), 1.6 %; a quantile's rank is off by 1.33 % at most with 99 % confidence (K = 200).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION, K = 12, 200
#: Three standard errors of a distinct count, and the bound of a rank.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (PRECISION / 2), 0.0133


def sketch(rows: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """(by, items, values) with one row a batch; nulls aren't counted. Partial sketches are made before the shuffle."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(item, PRECISION).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("values"))


def merged(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of larger groups, or of everything, from those of their batches."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def n_items() -> Column:
    """How many different items a sketch has seen."""
    return F.hll_sketch_estimate("items")


def n_values() -> Column:
    """How many values it has seen; exact."""
    return F.kll_sketch_get_n_double("values")


def quantile(rank: float) -> Column:
    """The value at a rank from 0 to 1."""
    return F.kll_sketch_get_quantile_double("values", F.lit(rank))
