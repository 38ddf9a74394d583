"""As-of, interval and boundary joins, change ranges and order checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions.constants import NATIVE, RATE_ONE
from marketflow.operators.scan import largest_group, next_row, prefix_last, prefix_max, prefix_sum, previous_row
from marketflow.session import max_group_rows


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    *,
    allow_equal: bool = True,
    tie: str | None = None,
    out: str = "asof",
) -> DataFrame:
    """Left rows with the latest right row at or before them, as a struct of ``values``.

    The right row is carried as a struct, so a NULL stored in it is found like any value and hides
    older ones. ``tie`` orders right rows of equal position. Both inputs form one ordered stream per
    key and are scanned once: the cost is linear in the rows, whatever the number of right rows.
    """
    by = list(by)
    names = left.columns
    left_tag, right_tag = (1, 0) if allow_equal else (0, 1)
    # The tie keeps its type, so that numbers compare as numbers; left rows have none.
    tie_type = right.schema[tie].dataType if tie else "string"
    packed_left = left.select(
        *by, F.col(left_on).alias("_at"), F.lit(left_tag).alias("_tag"), F.lit(None).cast(tie_type).alias("_tie"),
        F.struct(*names).alias("_left"),
    )
    tie_value = F.col(tie) if tie else F.lit(None).cast("string")
    packed_right = right.select(
        *by, F.col(right_on).alias("_at"), F.lit(right_tag).alias("_tag"), tie_value.alias("_tie"),
        F.struct(*values).alias("_right"),
    )
    stream = packed_left.unionByName(packed_right, allowMissingColumns=True)
    gate = left.select(*by).unionByName(right.select(*by))
    found = prefix_last(stream, by, ["_at", "_tag", "_tie"], "_right", "_hit", gate=gate)
    return found.filter("_left is not null").select("_left.*", F.col("_hit").alias(out))


def tick_size_asof(rows: DataFrame, ticks: DataFrame, account: str, out: str) -> DataFrame:
    """Tick size in force for ``account`` at the row's ledger; NULL when none or removed."""
    right = ticks.select(F.col("account").alias(account), F.col("ledger_index").alias("_from"), "tick_size")
    joined = asof_join(rows, right, [account], "ledger_index", "_from", ["tick_size"])
    return joined.withColumn(out, F.col("asof.tick_size")).drop("asof")


def effective_tick_size(intents: DataFrame, ticks: DataFrame) -> DataFrame:
    """Smaller tick size of the two issued assets of an offer; NULL for payments and native assets.

    Both assets are looked up in one scan: an offer becomes one row per issued asset.
    """
    issuers = F.filter(
        F.array(
            F.when(F.col("in_currency") != NATIVE, F.col("in_issuer")),
            F.when(F.col("out_currency") != NATIVE, F.col("out_issuer")),
        ),
        lambda c: c.isNotNull(),
    )
    offers = intents.filter(F.col("transaction_type") == "OFFERCREATE")
    sides = offers.select("tx_hash", "ledger_index", F.explode(F.array_distinct(issuers)).alias("account"))
    sized = tick_size_asof(sides, ticks, "account", "tick_size")
    smallest = sized.groupBy("tx_hash").agg(F.min("tick_size").alias("tick_size"))
    return intents.join(smallest, "tx_hash", "left")


def disjoint_ranges(ranges: DataFrame, by: Sequence[str], first: str, last: str) -> DataFrame:
    """Ranges cut so that the range with the smallest start keeps the overlap; empty ones dropped.

    A ledger is covered by an earlier-starting range exactly when it is at most the largest end seen
    so far, so each start moves behind that end.
    """
    seen = prefix_max(ranges, by, [first, last], last, "_ends")
    start = F.greatest(F.col(first), F.col("_ends") + 1)
    return seen.withColumn(first, start).drop("_ends").filter(F.col(first) <= F.col(last))


def interval_join(
    left: DataFrame,
    ranges: DataFrame,
    by: Sequence[str],
    at: str,
    first: str,
    last: str,
    values: Sequence[str],
    *,
    disjoint: bool = False,
    out: str = "hit",
) -> DataFrame:
    """Left rows with the range that holds ``at``; overlaps go to the smallest start.

    With disjoint ranges the only candidate is the latest one starting at or before the row, so this
    is an as-of scan followed by a test of the range's end, not a range comparison of all pairs.
    """
    cut = ranges if disjoint else disjoint_ranges(ranges, by, first, last)
    cut = cut.withColumnsRenamed({first: "_first", last: "_last"})
    joined = asof_join(left, cut, by, at, "_first", ["_last", *values], out="_asof")
    inside = F.col("_asof._last") >= F.col(at)
    return joined.withColumn(
        out, F.when(inside, F.struct(*[F.col(f"_asof.{v}").alias(v) for v in values]))
    ).drop("_asof")


def rate_join(rows: DataFrame, ranges: DataFrame, static: DataFrame, *, strict: bool = True) -> DataFrame:
    """Transfer rate of the row's (currency, issuer) at its ledger: range, else static, else error.

    The native asset has rate one. ``strict=False`` leaves a missing rate NULL.
    """
    on = ["currency", "issuer"]
    joined = interval_join(rows, ranges, on, "ledger_index", "first_ledger", "last_ledger", ["transfer_rate"])
    joined = joined.join(static.select(*on, F.col("transfer_rate").alias("_static")), on, "left")
    rate = F.coalesce(F.col("hit.transfer_rate"), F.col("_static"))
    if strict:
        missing = F.raise_error(F.concat_ws(":", F.lit("no transfer rate for"), *on)).cast("bigint")
        rate = F.coalesce(rate, missing)
    rate = F.when(F.col("currency") == NATIVE, F.lit(RATE_ONE).cast("bigint")).otherwise(rate)
    return joined.withColumn("transfer_rate", rate).drop("hit", "_static")


def attach_boundary(rows: DataFrame, snapshots: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """State at position ``at - 1`` exactly; ``has_boundary`` is false when that snapshot is absent."""
    right = snapshots.select(
        *by, (F.col(at) + 1).alias(at), *values, F.lit(True).alias("has_boundary")
    )
    joined = rows.join(right, [*by, at], "left")
    return joined.withColumn("has_boundary", F.coalesce("has_boundary", F.lit(False)))


def rate_changes(meta: DataFrame) -> DataFrame:
    """Transfer-rate settings found in account-set records: (issuer, ledger, index, hash, rate)."""
    r = F.col("result")
    return meta.filter((r["TransactionType"] == "AccountSet") & r["TransferRate"].isNotNull()).select(
        r["Account"].alias("issuer"), "ledger_index", "transaction_index", "tx_hash",
        r["TransferRate"].alias("transfer_rate"),
    )


def change_ranges(
    observations: DataFrame, by: Sequence[str], at: str, value: str, *, tie: str, end: int | None = None
) -> DataFrame:
    """Runs of an unchanged value as (by, first, last, value, n): gaps-and-islands over ordered rows.

    A run lasts until the position before the next run, the final one until ``end`` (or its own last
    observation).
    """
    order = [at, tie]
    seen = previous_row(observations, by, order, [value], "_prev", gate=observations)
    changed = F.col("_prev").isNull() | ~F.col(value).eqNullSafe(F.col(f"_prev.{value}"))
    flagged = seen.withColumn("_new", changed.cast("bigint")).drop("_prev")
    runs = prefix_sum(flagged, by, order, "_new", "_run", inclusive=True, gate=observations)
    spans = runs.groupBy(*by, "_run").agg(
        F.min(at).alias("first"), F.max(at).alias("_seen"), F.min(value).alias(value), F.count(F.lit(1)).alias("n")
    )
    following = next_row(spans, by, ["_run"], ["first"], "_next", gate=observations)
    final = F.col("_seen") if end is None else F.greatest(F.col("_seen"), F.lit(end))
    last = F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next.first") - 1, F.col("first"))).otherwise(final)
    return following.select(*by, "first", last.alias("last"), value, "n")


def ledger_bounds(targets: DataFrame) -> DataFrame:
    return targets.agg(F.min("ledger_index").alias("first_ledger"), F.max("ledger_index").alias("last_ledger"))


def bound_rates(issuers: DataFrame, changes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(issuer, start_rate, end_rate) of every issuer: in force as the window opens and after its last ledger, from the settings found.

    An issuer that set none before has rate one. ``bounds`` is the one row of :func:`ledger_bounds`.
    """
    set_by = lambda test: F.max(F.when(test, F.struct("ledger_index", "transaction_index", "transfer_rate")))["transfer_rate"]
    seen = changes.crossJoin(F.broadcast(bounds)).groupBy("issuer").agg(
        set_by(F.col("ledger_index") < F.col("first_ledger")).alias("start_rate"), set_by(F.col("ledger_index") <= F.col("last_ledger")).alias("end_rate"))
    joined = issuers.select("issuer").filter("issuer is not null").distinct().join(seen, "issuer", "left")
    return joined.select("issuer", *[rate_in_force(F.col(c)).alias(c) for c in ("start_rate", "end_rate")])


def rate_in_force(rate: Column) -> Column:
    """Rate a setting leads to: none and zero (which takes a rate away) are rate one."""
    return F.when(rate > 0, rate.cast("bigint")).otherwise(F.lit(RATE_ONE).cast("bigint"))


def rate_ranges(targets: DataFrame, changes: DataFrame, rates: DataFrame) -> DataFrame:
    """Per issuer the ranges of an unchanged transfer rate over the target window, in order.

    A range holds for the transactions after (``first_ledger``, ``first_index``) up to and including (``last_ledger``, ``last_index``):
    a transaction that sets a rate runs under the old one. The first range opens the window (index -1), the last one ends with it
    (index NULL). ``tx_hash`` is the setting that began the range; settings to the rate in force begin none but count in
    ``n_changes``, an issuer's settings inside the window.

    ``changes`` are those of :func:`rate_changes`; ``rates`` holds (issuer, start_rate, end_rate) at the window bounds and names the
    issuers asked for. ``status`` is ``single`` for equal ends without changes, ``changed_inside`` or ``ends_differ`` otherwise; in the
    last case the records do not tell the rate, which is NULL.
    """
    bounds = ledger_bounds(targets)
    at = ["ledger_index", "transaction_index"]
    opening = rates.crossJoin(F.broadcast(bounds)).select(  # bounds is one row
        "issuer", F.col("first_ledger").alias("ledger_index"), F.lit(-1).cast("bigint").alias("transaction_index"), F.lit(None).cast("string").alias("tx_hash"),
        F.col("start_rate").cast("bigint").alias("transfer_rate"), F.lit(True).alias("_opening"))
    inside = changes.crossJoin(F.broadcast(bounds)).filter(F.col("ledger_index").between(F.col("first_ledger"), F.col("last_ledger")))
    inside = inside.join(rates.select("issuer"), "issuer", "left_semi").select(
        "issuer", "ledger_index", F.col("transaction_index").cast("bigint").alias("transaction_index"), "tx_hash", rate_in_force(F.col("transfer_rate")).alias("transfer_rate"))
    small = largest_group(changes, ["issuer"])[1] < max_group_rows(changes.sparkSession)
    stream = opening.unionByName(inside, allowMissingColumns=True)
    seen = previous_row(stream, ["issuer"], at, ["transfer_rate"], "_prev", bounded=small)
    begun = seen.filter(F.col("_opening").isNotNull() | ~F.col("transfer_rate").eqNullSafe(F.col("_prev.transfer_rate"))).drop("_prev")
    ranges = next_row(begun, ["issuer"], at, at, "_next", bounded=small)
    counted = rates.join(inside.groupBy("issuer").agg(F.count(F.lit(1)).alias("n_changes")), "issuer", "left").select(
        "issuer", F.coalesce("n_changes", F.lit(0)).alias("n_changes"), F.col("start_rate").eqNullSafe(F.col("end_rate")).alias("_equal"))
    joined = ranges.drop("_opening").join(counted, "issuer").crossJoin(F.broadcast(bounds.select(F.col("last_ledger").alias("_end"))))
    status = F.when(F.col("n_changes") > 0, "changed_inside").when(~F.col("_equal"), "ends_differ").otherwise("single")
    return joined.select(
        "issuer", F.col("ledger_index").alias("first_ledger"), F.col("transaction_index").alias("first_index"),
        F.coalesce("_next.ledger_index", "_end").alias("last_ledger"), F.col("_next.transaction_index").alias("last_index"),
        "tx_hash", "n_changes", status.alias("status"), F.when(status != "ends_differ", F.col("transfer_rate")).alias("transfer_rate"),
    )


def check_order(rows: DataFrame, group: str = "ledger_index", index: str = "transaction_index", *, start: int = 0) -> DataFrame:
    """Coverage gaps per group: positions must begin at ``start`` and step by one.

    One row per violation with the expected and the found position.
    """
    spaced = previous_row(rows.select(group, index), [group], [index], [index], "_prev", gate=rows)
    expected = F.coalesce(F.col(f"_prev.{index}") + 1, F.lit(start))
    return spaced.select(group, expected.cast("bigint").alias("expected"), F.col(index).cast("bigint").alias("found")).filter(
        "expected <> found"
    )


def order_violations(rows: DataFrame, position: str, group: str = "ledger_index", index: str = "transaction_index") -> DataFrame:
    """Rows whose (group, index) is below that of the row before them in input position.

    A range partition on the position keeps this linear: only neighbours are compared.
    """
    keyed = rows.withColumn("_all", F.lit(0))
    seen = previous_row(keyed, ["_all"], [position], [group, index], "_prev")
    below = (F.col(group) < F.col(f"_prev.{group}")) | (
        (F.col(group) == F.col(f"_prev.{group}")) & (F.col(index) < F.col(f"_prev.{index}"))
    )
    return seen.filter(F.coalesce(below, F.lit(False))).select(
        position, group, index, F.col(f"_prev.{group}").alias("previous_group"),
        F.col(f"_prev.{index}").alias("previous_index"),
    )
