"""Ordered scans over groups of any size.

A window ordered inside ``partitionBy(key)`` sorts a whole group in one task, which fails when one
key holds a large share of the rows. Every ordered operator here first measures the largest group.
Groups within the limit use the ordinary window. Otherwise the rows are range partitioned on
(key, order), so a large group spreads over consecutive blocks, the blocks are written to the
checkpoint folder (their numbering must not change between the two passes), the window runs inside
(block, key), and one small summary row per (block, key) carries the state across block borders.
Only the first key of a block can continue from the block before it, so the carried table holds at
most one row per block and is safe to broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.session import checkpoint, max_group_rows, shuffle_partitions

BLOCK = "_block"


def order_columns(order: Sequence[str]) -> list[Column]:
    """``"a"`` sorts ascending with NULLs first, ``"-a"`` descending with NULLs last."""
    return [F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order]


def reverse_order(order: Sequence[str]) -> list[str]:
    return [c[1:] if c.startswith("-") else f"-{c}" for c in order]


@dataclass(frozen=True)
class Lanes:
    """Rows to scan, with the columns that bound one task's group."""

    df: DataFrame
    by: list[str]
    order: list[str]
    blocked: bool

    @property
    def parts(self) -> list[str]:
        return [BLOCK, *self.by] if self.blocked else self.by

    def window(self):
        return Window.partitionBy(*self.parts).orderBy(*order_columns(self.order))

    def finish(self, df: DataFrame) -> DataFrame:
        return df.drop(BLOCK)


def largest_group(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Total rows and rows of the largest group; reads the key columns only."""
    row = (
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .first()
    )
    return int(row["total"] or 0), int(row["largest"] or 0)


def lanes(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> Lanes:
    """Choose plain groups or blocks.

    ``bounded=True`` states that the data model bounds a group (the nodes of one transaction record,
    the changes of one ledger), so nothing is measured. ``gate`` may name a cheaper DataFrame whose
    groups are at least as large.
    """
    by, order = list(by), list(order)
    if bounded:
        return Lanes(df, by, order, False)
    limit = max_group_rows(df.sparkSession)
    total, largest = largest_group(df if gate is None else gate, by)
    if largest <= limit:
        return Lanes(df, by, order, False)
    blocks = max(shuffle_partitions(df.sparkSession), math.ceil(total / limit))
    ranged = df.repartitionByRange(blocks, *[F.asc_nulls_first(c) for c in by], *order_columns(order))
    return Lanes(checkpoint(ranged.withColumn(BLOCK, F.spark_partition_id())), by, order, True)


def _carry(local: DataFrame, scan: Lanes, summary: Column, combine) -> DataFrame:
    """State each block inherits for the key it continues: at most one row per block."""
    across = Window.partitionBy(*scan.by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy(BLOCK, *scan.by).agg(summary.alias("_own"))
    return (
        totals.withColumn("_in", combine(F.col("_own"), across))
        .withColumn("_prior", F.count(F.lit(1)).over(across))
        .filter("_prior > 0")
        .select(F.col(BLOCK).alias("_cblock"), *[F.col(c).alias(f"_c_{c}") for c in scan.by], "_in")
    )


def _attach(local: DataFrame, carried: DataFrame, scan: Lanes) -> DataFrame:
    on = F.col(BLOCK) == F.col("_cblock")
    for name in scan.by:
        on = on & F.col(name).eqNullSafe(F.col(f"_c_{name}"))
    joined = local.join(F.broadcast(carried), on, "left")
    return joined.drop("_cblock", *[f"_c_{c}" for c in scan.by])


def _prefix_fold(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    fold,
    join_parts,
    inclusive: bool,
    bounded: bool,
    gate: DataFrame | None,
) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    scan = lanes(df.withColumn("_v", value), by, order, bounded=bounded, gate=gate)
    frame = scan.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = scan.df.withColumn("_local", fold("_v").over(frame))
    if not scan.blocked:
        return local.withColumn(out, join_parts(F.col("_local"), None)).drop("_local", "_v")
    carried = _carry(scan.df, scan, fold("_v"), lambda own, w: fold(own).over(w))
    joined = _attach(local, carried, scan)
    return scan.finish(
        joined.withColumn(out, join_parts(F.col("_local"), F.col("_in"))).drop("_local", "_in", "_v")
    )


def prefix_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    *,
    inclusive: bool = False,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Running sum of ``value`` over earlier rows (and the row itself when ``inclusive``).

    ``order`` must be total inside a group. The first row of an exclusive sum gets 0.
    """

    def add(local: Column, carried: Column | None) -> Column:
        zero = F.lit(0)
        own = F.coalesce(local, zero)
        return own if carried is None else own + F.coalesce(carried, zero)

    return _prefix_fold(df, by, order, value, out, F.sum, add, inclusive, bounded, gate)


def prefix_max(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str | Column,
    out: str,
    *,
    inclusive: bool = False,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Running maximum over earlier rows; NULL when there are none."""

    def larger(local: Column, carried: Column | None) -> Column:
        return local if carried is None else F.greatest(local, carried)

    return _prefix_fold(df, by, order, value, out, F.max, larger, inclusive, bounded, gate)


def row_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    out: str,
    *,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """1-based position inside the group."""
    return prefix_sum(
        df, by, order, F.lit(1).cast("bigint"), out, inclusive=True, bounded=bounded, gate=gate
    )


def prefix_last(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    payload: str,
    out: str,
    *,
    inclusive: bool = True,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Latest non-NULL ``payload`` seen so far. Wrap values in a struct when NULL is data."""
    scan = lanes(df, by, order, bounded=bounded, gate=gate)
    frame = scan.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = scan.df.withColumn("_local", F.last(payload, ignorenulls=True).over(frame))
    if not scan.blocked:
        return local.withColumnRenamed("_local", out)
    placed = scan.df.withColumn("_pos", F.row_number().over(scan.window()))
    newest = F.max_by(F.col(payload), F.when(F.col(payload).isNotNull(), F.col("_pos")))
    carried = _carry(placed, scan, newest, lambda own, w: F.last(own, ignorenulls=True).over(w))
    joined = _attach(local, carried, scan)
    return scan.finish(joined.withColumn(out, F.coalesce("_local", "_in")).drop("_local", "_in"))


def previous_row(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    out: str,
    *,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Struct of the previous row's ``columns``; NULL on the first row of a group."""
    packed = df.withColumn("_row", F.struct(*columns))
    done = prefix_last(packed, by, order, "_row", out, inclusive=False, bounded=bounded, gate=gate)
    return done.drop("_row")


def next_row(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    out: str,
    *,
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Struct of the next row's ``columns``: the previous row of the reversed order."""
    return previous_row(df, by, reverse_order(order), columns, out, bounded=bounded, gate=gate)


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    The ``rank <= k`` filter lets Spark keep only ``k`` rows per key in each map task before the
    shuffle (window group limit), so a large group costs ``k`` rows per task.
    """
    window = Window.partitionBy(*by).orderBy(*order_columns(order))
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based position in one total order of all rows."""
    return row_rank(df.withColumn("_all", F.lit(0)), ["_all"], order, out).drop("_all")
