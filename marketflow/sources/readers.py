"""Scans. Every reader returns a lazy DataFrame, so filters and column pruning reach the files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.sources.schemas import (
    BOOK_SNAPSHOT,
    METADATA,
    PAIRS,
    SAME_FILL,
    parsed,
    require_columns,
)

CORRUPT = "_corrupt_record"
LEDGERS_PER_BUCKET = 10_000

SWAP_KEYS = ("transaction_hash", "ledger_index", "transaction_index")
LEG_KEYS = ("ledger_index", "transaction_index")


def read_fact(spark: SparkSession, source: str, table: str) -> DataFrame:
    """Fact table from a share (``profile#share.schema``) or a folder of parquet tables."""
    if "#" in source:
        return spark.read.format("deltaSharing").load(f"{source}.{table}")
    return spark.read.parquet(f"{source.rstrip('/')}/{table}")


def normalise_swaps(df: DataFrame) -> DataFrame:
    require_columns(df, SWAP_KEYS, "pool swaps")
    return df.withColumnRenamed("transaction_hash", "tx_hash")


def normalise_legs(df: DataFrame) -> DataFrame:
    """Book legs carry the hash as ``tx_hash``, ``transaction_hash`` or both."""
    names = [c for c in ("tx_hash", "transaction_hash") if c in df.columns]
    require_columns(df, LEG_KEYS if names else (*LEG_KEYS, "tx_hash"), "book legs")
    rest = [c for c in df.columns if c not in names]
    return df.select(F.coalesce(*names).alias("tx_hash"), *rest)


def read_swaps(spark: SparkSession, path: str) -> DataFrame:
    return normalise_swaps(spark.read.parquet(path))


def read_legs(spark: SparkSession, path: str) -> DataFrame:
    return normalise_legs(spark.read.parquet(path))


def scan_for_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is in ``keys``; the planner broadcasts a key set of small measured size."""
    wanted = keys.select(keys[keys.columns[0]].alias("_key")).distinct()
    return df.join(wanted, df[column] == F.col("_key"), "left_semi")


def key_set(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct non-NULL key rows; only the key columns are read."""
    return df.select(*columns).dropna().distinct()


def read_metadata(spark: SparkSession, path: str | Sequence[str], *, on_bad: str = "fail") -> DataFrame:
    """Newline-delimited transaction metadata. Blank lines are skipped.

    ``on_bad="fail"`` stops at a malformed line; ``"quarantine"`` keeps its text in
    ``_corrupt_record`` for :func:`marketflow.sources.writers.split_bad`.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if on_bad == "fail":
        return spark.read.schema(METADATA).option("mode", "FAILFAST").json(paths)
    # Parsed from text, because the JSON source cannot answer a query that reads only the corrupt column.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    record = F.from_json("value", parsed(f"{METADATA}, {CORRUPT} string"), options)
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    return lines.select(record.alias("_r")).select("_r.*")


def parse_metadata(df: DataFrame, column: str, *, on_bad: str = "null") -> DataFrame:
    """Metadata held as JSON text in a column; unreadable text yields NULL fields, or stops the job with ``on_bad="fail"``."""
    record = F.from_json(F.col(column), parsed(METADATA), {"mode": "FAILFAST"} if on_bad == "fail" else {})
    return df.select(record.alias("_r")).select("_r.*")


def read_results(spark: SparkSession, root: str, files: str = "results.ndjson") -> DataFrame:
    """Same-fill results in one folder per pair; the folder names the pair.

    ``files`` is the file name or pattern inside a folder; a folder may be called ``pair=NAME``.
    """
    raw = spark.read.schema(SAME_FILL).json(f"{root.rstrip('/')}/*/{files}")
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return raw.select(F.regexp_replace(F.url_decode(folder), "^pair=", "").alias("pair"), "*")


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Delimited text with a header; the separator is taken from the header line."""
    if sep is None:
        head = spark.read.text(path).filter(F.trim("value") != "").first()
        line = head["value"] if head else ""
        sep = "\t" if line.count("\t") > line.count(",") else ","
    return spark.read.option("header", True).option("sep", sep).csv(path)


def _position() -> Column:
    """Input order of file rows: file, split, then row inside the split."""
    return F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )


def distinct_in_order(df: DataFrame, key: str, position: str, limit: int | None = None) -> DataFrame:
    """Each key once at its first position, optionally the first ``limit`` keys."""
    first = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min(position).alias(position))
    ordered = first.orderBy(position)
    return ordered.limit(limit) if limit is not None else ordered


def read_key_list(
    spark: SparkSession, path: str, *, column: str | None = None, limit: int | None = None
) -> DataFrame:
    """Transaction hashes from text, CSV or parquet: trimmed, upper case, first occurrence kept."""
    if path.endswith(".parquet") or path.endswith(".csv") or path.endswith(".tsv"):
        table = spark.read.parquet(path) if path.endswith(".parquet") else read_delimited(spark, path)
        names = [column] if column else [c for c in ("tx_hash", "transaction_hash") if c in table.columns]
        require_columns(table, names or ["tx_hash"], path)
        raw = table.select(F.coalesce(*names).alias("value"), _position().alias("_at"))
    else:
        raw = spark.read.text(path).select("value", _position().alias("_at"))
        raw = raw.filter(~F.ltrim("value").startswith("#"))
    keys = raw.select(F.upper(F.trim("value")).alias("tx_hash"), "_at")
    return distinct_in_order(keys, "tx_hash", "_at", limit).select("tx_hash")


def read_ledger_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ledger numbers in ascending order."""
    number = F.trim("value").try_cast("bigint").alias("ledger_index")
    return spark.read.text(path).select(number).dropna().distinct().orderBy("ledger_index")


def _tick_map(text: str, place: Column) -> Column:
    """Map of sizes in a JSON text, nested under ``tick_sizes`` or flat; what is neither fails the job, naming its ``place``."""
    nested = F.from_json(text, "tick_sizes map<string,int>")["tick_sizes"]
    broken = F.raise_error(F.concat(F.lit("unreadable tick sizes: "), place)).cast("map<string,int>")
    return F.coalesce(nested, F.from_json(text, "map<string,int>"), broken)


def read_tick_sizes(spark: SparkSession, path: str) -> DataFrame:
    """One JSON map per ledger file as (ledger_index, account, tick_size); a NULL size is a value.

    The ledger is the number before ``.json`` in the file's name, or that of its folder ``ledger_index=N``.

    A file that is no JSON map fails the job: without its ledger an as-of lookup would fall back to older sizes.
    """
    raw = spark.read.option("wholetext", True).text(path)
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("bigint")
    ledger = F.coalesce(number(r"(\d+)\.json$"), number(r"ledger_index=(\d+)/[^/]+$"))
    return raw.select(ledger.alias("ledger_index"), F.explode(_tick_map("value", F.col("_metadata.file_path"))).alias("account", "tick_size"))


def read_packed_tick_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The same maps packed by :func:`writers.write_tick_sizes`: a line per ledger, its number before a tab, many ledgers a file.

    A file per ledger costs the driver and the store a few requests each, however small; packed, their number does not grow with the
    ledgers. A line without a number or a map fails the job.
    """
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).select("value", parts[0].try_cast("bigint").alias("ledger_index"), F.get(parts, F.lit(1)).alias("map"))
    missing = F.raise_error(F.concat(F.lit("unreadable tick sizes: "), F.col("value"))).cast("bigint")
    return lines.select(F.coalesce("ledger_index", missing).alias("ledger_index"), F.explode(_tick_map("map", F.col("value"))).alias("account", "tick_size"))


def read_book(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Book snapshots of a ledger range; the bucket filter prunes the partition folders."""
    frame = spark.read.schema(f"{BOOK_SNAPSHOT}, ledger_bucket bigint").parquet(path)
    return in_ledger_range(frame, first, last)


def in_ledger_range(df: DataFrame, first: int, last: int) -> DataFrame:
    bucket = F.col("ledger_bucket").between(first // LEDGERS_PER_BUCKET, last // LEDGERS_PER_BUCKET)
    return df.filter(bucket & F.col("ledger_index").between(first, last)).drop("ledger_bucket")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair configuration, one row per pair, window and counter asset filled from the file level.

    The pair key is the label with ``_`` in place of ``/``, because the two spellings coexist.
    """
    raw = spark.read.schema(PAIRS).option("multiLine", True).json(path)
    pair = F.explode("pairs").alias("p")
    rows = raw.select(pair, "ledger_start", "ledger_end", "counter_currency", "counter_issuer")
    start = F.coalesce("p.ledger_start", "ledger_start")
    end = F.coalesce("p.ledger_end", "ledger_end")
    label = F.coalesce("p.pair_label", "p.pair")
    return rows.select(
        F.col("p.pair").alias("pair"),
        F.replace(label, F.lit("/"), F.lit("_")).alias("pair_key"),
        "p.base_label",
        "p.base_currency",
        F.coalesce("p.base_issuer", F.lit("")).alias("base_issuer"),
        "p.base_currency_candidates",
        F.coalesce("p.counter_currency", "counter_currency").alias("counter_currency"),
        F.coalesce("p.counter_issuer", "counter_issuer", F.lit("")).alias("counter_issuer"),
        start.alias("ledger_start"),
        end.alias("ledger_end"),
        F.coalesce("p.window", F.concat_ws("_", F.lit("ledger"), start, end)).alias("window"),
    )
