"""Exact percentiles of groups of any size.

Values are counted per (group, value) first, so repeated values combine before the shuffle and a
large group spreads over its values. A running count then locates the wanted ranks. Four rank rules
coexist; each names the rank (1-based) it reads from ``n`` sorted values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.operators.scan import prefix_sum


def nearest_rank(percent: int) -> Column:
    """max(1, ceil(n * percent / 100))."""
    return F.greatest(F.lit(1), F.floor((F.col("_n") * percent + 99) / 100)).cast("bigint")


def ceiling_rank(quantile: float) -> Column:
    """Zero-based index ceil((n - 1) * quantile)."""
    scaled = (F.col("_n") - 1).cast("decimal(20,0)") * F.lit(str(quantile)).cast("decimal(10,6)")
    return (F.ceil(scaled) + 1).cast("bigint")


def _linear_position(quantile: float) -> Column:
    return (F.col("_n") - 1).cast("double") * F.lit(float(quantile))


def ranked_values(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column]
) -> DataFrame:
    """Value found at each rank, per group; NULL values are left out."""
    by = list(by)
    kept = df.filter(F.col(value).isNotNull()).select(*by, value)
    if not by:
        kept, by = kept.withColumn("_all", F.lit(0)), ["_all"]
    counts = kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    running = prefix_sum(counts, by, [value], "_c", "_upto", inclusive=True, gate=kept)
    # A NULL group is a group: keys are compared null-safe.
    right = totals.select(*[F.col(c).alias(f"_t_{c}") for c in by], "_n")
    match = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    joined = running.join(right, reduce(and_, match)).drop(*[f"_t_{c}" for c in by])
    picks = [F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    out = joined.groupBy(*by).agg(F.max("_n").alias("n_values"), *picks)
    return out.drop("_all")


def percentile_nearest(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int], prefix: str = "p") -> DataFrame:
    return ranked_values(df, by, value, {f"{prefix}{p}": nearest_rank(p) for p in percents})


def percentile_ceil(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    return ranked_values(df, by, value, {name: ceiling_rank(q) for name, q in quantiles.items()})


def percentile_linear(df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """Interpolation at (n - 1) * q between the two neighbouring values, as DOUBLE."""
    ranks: dict[str, Column] = {}
    for name, q in quantiles.items():
        ranks[f"_lo_{name}"] = (F.floor(_linear_position(q)) + 1).cast("bigint")
        ranks[f"_hi_{name}"] = (F.ceil(_linear_position(q)) + 1).cast("bigint")
    found = ranked_values(df, by, value, ranks).withColumn("_n", F.col("n_values"))
    for name, q in quantiles.items():
        weight = _linear_position(q) - F.floor(_linear_position(q))
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        found = found.withColumn(name, low + (high - low) * weight)
    return found.select(*[c for c in by], "n_values", *quantiles)
