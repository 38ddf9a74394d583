"""Sinks: parquet, CSV, JSON lines, manifests and the quarantine split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketflow.sources.readers import LEDGERS_PER_BUCKET


def write_table(df: DataFrame, path: str, *, sort: Sequence[str] | None = None) -> None:
    """Overwrite parquet, optionally in one global order with NULLs last."""
    out = df.orderBy(*[F.asc_nulls_last(c) for c in sort]) if sort else df
    out.write.mode("overwrite").parquet(path)


def write_book(df: DataFrame, path: str) -> None:
    """Book snapshots partitioned by ledger bucket, clustered so that each bucket has few files."""
    bucketed = df.withColumn("ledger_bucket", F.floor(F.col("ledger_index") / LEDGERS_PER_BUCKET).cast("bigint"))
    ranged = bucketed.repartitionByRange("ledger_bucket", "ledger_index")
    ranged.write.mode("overwrite").partitionBy("ledger_bucket").parquet(path)


def write_tick_sizes(maps: DataFrame, path: str) -> None:
    """JSON maps of (ledger_index, value) packed for :func:`readers.read_packed_tick_sizes`: a line per ledger, as many files as tasks."""
    line = F.concat(F.col("ledger_index").cast("string"), F.lit("\t"), F.regexp_replace("value", r"[\r\n]+", " "))  # JSON breaks lines between tokens only
    maps.select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is meant for reports: only the last step, the writing, is one task, whatever the size."""
    if single_file:
        df = df.repartition(1)  # coalesce(1) would run the whole plan before it in that task
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merge_shards(df: DataFrame, ledgers: DataFrame, order: Sequence[str] = ("ledger_index",)) -> DataFrame:
    """Requested ledgers of many shards in ledger order: range partitioned, sorted inside partitions."""
    kept = df.join(ledgers.select("ledger_index").distinct(), "ledger_index", "left_semi")
    return kept.repartitionByRange(*order).sortWithinPartitions(*order)


def write_manifest(
    df: DataFrame, path: str, *, metrics: Mapping[str, Column], facts: Mapping[str, str] | None = None
) -> dict:
    """Write ``df`` as parquet and its metrics as one JSON row, in a single pass over the data."""
    seen = Observation("manifest")
    df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.mode("overwrite").parquet(path)
    payload = {**(facts or {}), **seen.get}
    row = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in payload.items()])
    row.repartition(1).write.mode("overwrite").json(f"{path.rstrip('/')}_manifest")
    return payload


def with_reason(df: DataFrame, checks: Mapping[str, Column], out: str = "reject_reason") -> DataFrame:
    """First failed check by name, NULL for good rows. A check states what must hold."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(list(checks.items())):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn(out, reason)


def split_bad(
    df: DataFrame, checks: Mapping[str, Column], out: str = "reject_reason"
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failing rows with their reason."""
    marked = with_reason(df, checks, out)
    return marked.filter(F.col(out).isNull()).drop(out), marked.filter(F.col(out).isNotNull())
