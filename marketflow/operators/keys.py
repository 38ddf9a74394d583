"""Key joins, completeness checks and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.functions.constants import NATIVE


class IncompleteJoin(RuntimeError):
    """Rows without the partner they must have, or with more than one."""


def check_keys(left: DataFrame, right: DataFrame, on: Sequence[str], *, sample: int = 5) -> DataFrame:
    """One row per problem: keys of ``left`` missing in ``right``, and keys repeated on either side.

    ``sample_keys`` holds the first ``sample`` keys in text order.
    """
    on = list(on)
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in on])

    def summary(df: DataFrame, problem: str) -> DataFrame:
        keyed = df.select(text.alias("key"))
        first = keyed.orderBy("key").limit(sample).groupBy().agg(F.sort_array(F.collect_list("key")).alias("sample_keys"))
        counts = keyed.groupBy().agg(
            F.lit(problem).alias("problem"),
            F.count(F.lit(1)).alias("n"),
            F.min("key").alias("first_key"),
        )
        return counts.join(first)

    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")

    missing = left.select(*on).distinct().join(right.select(*on), on, "left_anti")
    report = summary(missing, "missing_right")
    report = report.unionByName(summary(repeated(left), "repeated_left"))
    return report.unionByName(summary(repeated(right), "repeated_right"))


def require_clean(report: DataFrame) -> None:
    """Raise when a :func:`check_keys` report names a problem. Collects its three rows only."""
    bad = [f"{r['problem']}: {r['n']} (first {', '.join(r['sample_keys'])})" for r in report.filter("n > 0").collect()]
    if bad:
        raise IncompleteJoin("; ".join(bad))


def join_required(left: DataFrame, right: DataFrame, on: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Left join in which every left row must find its right row.

    ``strict`` makes an unmatched row fail the job at run time; otherwise it is flagged in ``matched``.
    """
    joined = left.join(right.withColumn("matched", F.lit(True)), list(on), "left")
    if not strict:
        return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    proof = F.when(F.col("matched"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no partner for key "), key)).cast("boolean")
    )
    return joined.withColumn("matched", proof)


def attach_metadata(targets: DataFrame, meta: DataFrame) -> DataFrame:
    """Targets with their metadata record. Hash decides; a job fails where a target has none, or where both name a ledger and disagree."""
    right = meta.withColumnsRenamed(
        {"ledger_index": "metadata_ledger_index", "transaction_index": "metadata_transaction_index"}
    ).withColumn("_found", F.lit(True))
    absent = F.raise_error(F.concat(F.lit("no metadata for "), F.coalesce("tx_hash", F.lit("a target without hash")))).cast("string")
    joined = targets.join(right, "tx_hash", "left")
    joined = joined.withColumn("tx_hash", F.when(F.col("_found"), F.col("tx_hash")).otherwise(absent)).drop("_found")
    if "ledger_index" not in targets.columns or "metadata_ledger_index" not in joined.columns:
        return joined
    differs = F.col("ledger_index") != F.col("metadata_ledger_index")
    error = F.raise_error(F.concat(F.lit("metadata of another ledger for "), F.col("tx_hash")))
    proof = F.when(differs, error.cast(joined.schema["metadata_ledger_index"].dataType)).otherwise(F.col("metadata_ledger_index"))
    return joined.withColumn("metadata_ledger_index", proof)


def keep_targets(df: DataFrame, targets: DataFrame, on: str = "tx_hash") -> DataFrame:
    return df.join(targets.select(on).distinct(), on, "left_semi")


def pending(targets: DataFrame, done: DataFrame, on: Sequence[str], group: Sequence[str], item: str) -> DataFrame:
    """Targets not done yet, with their ``item`` values gathered per group in ascending order.

    Items are distinct before they are gathered; a group is one request, so its list is the request.
    """
    todo = targets.select(*on).distinct().join(done.select(*on), list(on), "left_anti")
    return todo.groupBy(*group).agg(F.sort_array(F.collect_set(item)).alias("items"))


def attach_book_side(intents: DataFrame, books: DataFrame) -> DataFrame:
    """Each intent with the book that gives its output asset."""
    side = F.when(F.col("out_currency") == NATIVE, "gets_native").otherwise("gets_issued")
    return intents.withColumn("side", side).join(books, ["tx_hash", "side"])


def attach_fee(swaps: DataFrame, fees: DataFrame, intents: DataFrame) -> DataFrame:
    """Swaps with their single fee row and the intent they serve.

    ``problem`` tells a missing or repeated row or a direction that differs from the intent's.
    """
    one_fee = fees.groupBy("tx_hash").agg(
        F.count(F.lit(1)).alias("fee_rows"),
        *[F.min(c).alias(c) for c in fees.columns if c != "tx_hash"],
    )
    one_swap = swaps.groupBy("tx_hash").agg(
        F.count(F.lit(1)).alias("swap_rows"),
        *[F.min(c).alias(c) for c in swaps.columns if c != "tx_hash"],
    )
    joined = one_swap.join(one_fee, "tx_hash", "left").join(
        intents.select("tx_hash", "in_currency", "out_currency"), "tx_hash"
    )
    same = (F.col("asset_in_currency") == F.col("in_currency")) & (
        F.col("asset_out_currency") == F.col("out_currency")
    )
    problem = (
        F.when(F.col("swap_rows") != 1, "repeated_swap")
        .when(F.coalesce("fee_rows", F.lit(0)) != 1, "not_one_fee")
        .when(~F.coalesce(same, F.lit(False)), "direction_mismatch")
    )
    return joined.withColumn("problem", problem)


def fill_lines(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """Balance of every requested (ledger, account, issuer, currency): an absent line is zero.

    More than one matching line sets ``problem``.
    """
    on = ["ledger_index", "owner_account", "issuer", "currency"]
    held = lines.groupBy(*on).agg(F.count(F.lit(1)).alias("n_lines"), F.min("balance").alias("balance"))
    joined = targets.select(*on).distinct().join(held, on, "left")
    found = F.col("n_lines").isNotNull()
    return joined.select(
        *on,
        F.when(found, F.col("balance")).otherwise(F.lit("0")).alias("balance"),
        F.when(found, "account_lines").otherwise("account_lines_missing_line_zero").alias("source"),
        F.when(F.col("n_lines") > 1, "multiple_lines").alias("problem"),
    )


def union_flagged(left: DataFrame, right: DataFrame, flags: tuple[str, str]) -> DataFrame:
    """Bag union in which each input sets its own flag to 1 and the other's to 0."""
    one, zero = F.lit(1), F.lit(0)
    marked_left = left.withColumns({flags[0]: one, flags[1]: zero})
    return marked_left.unionByName(right.withColumns({flags[0]: zero, flags[1]: one}))


def union_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def missing_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_anti")


def common_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.select(*on).distinct().join(right.select(*on), list(on), "left_semi")


def boundary_ledgers(sequence: DataFrame) -> DataFrame:
    """Ledgers whose closing state the targets start from: each ledger less one, distinct, ascending."""
    return sequence.select((F.col("ledger_index") - 1).alias("ledger_index")).distinct().orderBy("ledger_index")
