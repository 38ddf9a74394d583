"""Shared owner funds: allocation over offers, funding caps, owner floors and pool fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions.constants import FEE_MAX, FEE_SCALE
from marketflow.operators.scan import prefix_sum

UNITS = "decimal(38,0)"


def allocate_funds(
    offers: DataFrame,
    owner: list[str],
    order: list[str],
    *,
    size: str = "size",
    funds: str = "funds",
    rate: Column | None = None,
    unlimited: str | None = None,
    out: str = "allocated",
    bounded: bool = False,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Give each owner's funds to their offers, best offer first.

    ``size`` is the offer's output already cut to its own funding cap. A prefix of ``order`` uses the
    funds up, so an offer receives what its predecessors' full sizes leave over:
    ``min(size, max(0, funds - sum of earlier sizes))``. ``rate`` is what the owner pays per unit of
    output. Owners with NULL ``funds`` and ``unlimited`` rows are not limited and use nothing up.
    """
    held = F.col(funds)
    free = F.col(unlimited) if unlimited else F.lit(False)
    cost = F.col(size) if rate is None else F.col(size) * rate
    spent = F.when(free | held.isNull(), F.lit(0)).otherwise(cost)
    running = prefix_sum(offers, owner, order, spent, "_spent", bounded=bounded, gate=gate)
    left = F.greatest(held - F.col("_spent"), F.lit(0))
    left = left if rate is None else left / rate
    given = F.when(free | held.isNull(), F.col(size)).otherwise(F.least(F.col(size), left))
    return running.withColumn(out, given).drop("_spent")


def input_for_output(allocated: Column, size: Column, pays: Column, rate: Column) -> Column:
    """Input of a partly allocated offer: output times the quoted rate, at most the full input."""
    return F.when(allocated < size, F.least(pays, allocated * rate)).otherwise(pays)


def _take(state: Column, row: Column) -> Column:
    funded = F.least(row["size"], state["left"])
    capped = row["in_book"] & (row["book_size"] >= funded)
    # A listed offer whose book size is below its cap is passed over and keeps the balance whole.
    uses = ~row["in_book"] | capped
    return F.struct(
        F.when(uses, F.greatest(state["left"] - funded, F.lit(0).cast(UNITS))).otherwise(state["left"]).alias("left"),
        F.when(
            capped, F.concat(state["caps"], F.array(F.struct(row["sequence"].alias("sequence"), funded.alias("cap"))))
        ).otherwise(state["caps"]).alias("caps"),
    )


def funded_caps(book: DataFrame, account_offers: DataFrame, *, key: list[str]) -> DataFrame:
    """Funding cap of each book offer when its owner's offers are served in sequence order.

    ``book`` has ``key`` (which names one account snapshot, e.g. ledger, account and asset) plus
    (offer_id, sequence, size, funds); ``account_offers`` has ``key`` plus (sequence, size) and holds
    all the account's offers of that asset. The funds are those of the first offer in book order (``position``, where the book has
    it, else ``sequence``) that publishes any. Sizes and funds are integer units. An account's offer
    list is one snapshot record, so the gathered list is no larger than its input record.
    """
    first = "position" if "position" in book.columns else "sequence"
    owner = book.filter("funds is not null").groupBy(*key).agg(F.min_by("funds", first).alias("funds"))
    listed = book.select(*key, "sequence", F.col("size").alias("book_size"))
    offers = account_offers.join(listed, [*key, "sequence"], "left")
    row = F.struct(
        "sequence",
        F.col("size").cast(UNITS).alias("size"),
        F.coalesce(F.col("book_size"), F.lit(0)).cast(UNITS).alias("book_size"),
        F.col("book_size").isNotNull().alias("in_book"),
    )
    grouped = offers.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows")).join(owner, key)
    start = F.struct(
        F.col("funds").cast(UNITS).alias("left"),
        F.array().cast(f"array<struct<sequence:bigint,cap:{UNITS}>>").alias("caps"),
    )
    folded = grouped.withColumn("_caps", F.aggregate("rows", start, _take)["caps"])
    caps = folded.select(*key, F.inline("_caps"))
    return book.select(*key, "offer_id", "sequence").join(caps, [*key, "sequence"])


def owner_floor(offers: DataFrame, by: list[str], *, funds: str = "owner_funds", kind: str = "kind") -> DataFrame:
    """Smallest positive funds published over an account's offers, with a conflict flag.

    ``kind`` tells the asset domain; an account publishing two kinds is a conflict.
    """
    positive = F.col(funds) > 0
    return offers.groupBy(*by).agg(
        F.min(F.when(positive, F.col(funds))).alias("floor"),
        F.max(F.col(funds).isNotNull()).alias("has_funds"),
        (
            F.min(F.when(positive, F.col(kind))) != F.max(F.when(positive, F.col(kind)))
        ).alias("_mixed"),
    ).withColumn("conflict", F.coalesce("_mixed", F.lit(False))).drop("_mixed")


def apply_owner_floor(offers: DataFrame, by: list[str], *, funds: str = "owner_funds", kind: str = "kind") -> DataFrame:
    """Offers with the shared floor of their account in place of their own published funds."""
    floors = owner_floor(offers, by, funds=funds, kind=kind)
    joined = offers.join(floors.select(*by, "floor", "conflict"), by, "left")
    return joined.withColumn(funds, F.coalesce("floor", funds)).drop("floor")


def effective_fee(rows: DataFrame) -> DataFrame:
    """Fee units that explain a swap: the published fee the charged amount implies.

    Input columns: trading_fee, discounted_fee, trading_fee_value, trading_fee_currency,
    asset_in_currency, asset_in_value. ``fee_problem`` is set when no published fee explains the
    charge. Fees are fractions; one unit is 1/100000.
    """
    scale, tolerance = F.lit(FEE_SCALE), F.lit(1e-12)
    trading = F.round(F.col("trading_fee").cast("double") * scale).cast("bigint")
    exact = F.abs(F.col("trading_fee").cast("double") * scale - trading) < 1e-6
    shown = F.abs(F.col("discounted_fee").cast("double") - trading / F.lit(FEE_SCALE * 10)) <= tolerance
    discounted = F.when(F.col("discounted_fee").isNotNull(), F.floor(trading / 10)).cast("bigint")
    spent = F.col("asset_in_value").cast("double")
    implied = F.try_divide(F.col("trading_fee_value").cast("double"), spent)
    charged = F.col("trading_fee_value").isNotNull()
    is_trading = F.abs(implied - trading / scale) <= tolerance
    is_discounted = F.abs(implied - discounted / scale) <= tolerance
    neither = F.col("trading_fee").isNull() & F.col("discounted_fee").isNull()
    no = lambda c: F.coalesce(c, F.lit(False))
    problem = (
        F.when(neither, "no_published_fee")
        .when(F.col("trading_fee").isNotNull() & ~(exact & trading.between(0, FEE_MAX)), "invalid_fee")
        .when(F.col("discounted_fee").isNotNull() & ~no(shown), "invalid_discount")
        .when(charged & ~no(spent > 0), "non_positive_input")
        .when(
            charged & F.col("trading_fee_currency").isNotNull()
            & (F.col("trading_fee_currency") != F.col("asset_in_currency")),
            "fee_currency_mismatch",
        )
        .when(charged & ~no(is_trading) & ~no(is_discounted), "fee_not_explained")
    )
    units = (
        F.when(charged & no(is_trading), trading)
        .when(charged, discounted)
        .otherwise(F.coalesce(trading, discounted))
    )
    return rows.withColumn("fee_problem", problem).withColumn(
        "fee_units", F.when(F.col("fee_problem").isNull(), units)
    )


def funds_by_account(offers: DataFrame, by: list[str]) -> DataFrame:
    """Accounts that publish an explicit funded amount on any offer."""
    funded = F.col("taker_gets_funded").isNotNull() | F.col("taker_pays_funded").isNotNull()
    return offers.filter(funded & (F.coalesce("account", F.lit("")) != "")).select(*by).distinct()
