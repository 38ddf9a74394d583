"""Pair activity: sequence roll-up, composition, resolution, rankings and fetch targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.functions.constants import NATIVE
from marketflow.operators.keys import union_flagged
from marketflow.operators.percentiles import percentile_linear
from marketflow.operators.scan import global_rank
from marketflow.operators.select import normalise_keys, orient_pair


def tx_sequence(swaps: DataFrame, legs: DataFrame) -> DataFrame:
    """One row per transaction over pool swaps and book legs, in (ledger, index, hash) order."""
    names = ["tx_hash", "ledger_index", "transaction_index"]
    rows = normalise_keys(union_flagged(swaps.select(*names), legs.select(*names), ("has_amm", "has_clob")))
    rolled = rows.groupBy("tx_hash").agg(
        F.min("ledger_index").alias("ledger_index"),
        F.max("ledger_index").alias("_ledger_max"),
        F.min("transaction_index").alias("transaction_index"),
        F.max("transaction_index").alias("_index_max"),
        F.max("has_amm").alias("has_amm"),
        F.max("has_clob").alias("has_clob"),
    )
    return rolled.select(
        *names,
        "has_amm",
        "has_clob",
        (F.col("ledger_index") != F.col("_ledger_max")).cast("int").alias("ledger_mismatch"),
        (F.col("transaction_index") != F.col("_index_max")).cast("int").alias("txi_mismatch"),
    )


def ordered(sequence: DataFrame) -> DataFrame:
    return sequence.orderBy("ledger_index", "transaction_index", "tx_hash")


def venue_composition(sequence: DataFrame, by: list[str] | None = None) -> DataFrame:
    pool, book = F.coalesce("has_amm", F.lit(0)) > 0, F.coalesce("has_clob", F.lit(0)) > 0
    return sequence.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(pool).alias("amm"),
        F.count_if(book).alias("clob"),
        F.count_if(pool & book).alias("amm_clob"),
    )


def sequence_stats(sequence: DataFrame) -> DataFrame:
    """Manifest numbers of a sequence in one pass."""
    both = (F.col("has_amm") == 1) & (F.col("has_clob") == 1)
    return sequence.agg(
        F.count(F.lit(1)).alias("tx_unique"),
        F.count_if(F.col("has_amm") == 1).alias("tx_has_amm"),
        F.count_if(F.col("has_clob") == 1).alias("tx_has_clob"),
        F.count_if(both).alias("tx_has_both"),
        F.sum("ledger_mismatch").alias("ledger_mismatch_txs"),
        F.sum("txi_mismatch").alias("txi_mismatch_txs"),
        F.min("ledger_index").alias("ledger_min"),
        F.max("ledger_index").alias("ledger_max"),
        F.count_distinct("ledger_index").alias("prebook_unique_ledgers"),
    )


def ledger_activity(swaps: DataFrame, time: str = "close_time_datetime") -> DataFrame:
    """Swap count, first and last time and index range per ledger, busiest ledger first."""
    grouped = swaps.groupBy("ledger_index").agg(
        F.count(F.lit(1)).alias("amm_swap_count"),
        F.min(time).alias("amm_first_time"),
        F.max(time).alias("amm_last_time"),
        F.min("transaction_index").alias("amm_min_tx_index"),
        F.max("transaction_index").alias("amm_max_tx_index"),
    )
    return grouped.orderBy(F.desc("amm_swap_count"), "ledger_index")


def currency_candidates(pairs: DataFrame) -> DataFrame:
    """Currency codes a pair may appear under: configured ones, the label, its 40-digit code."""
    configured = F.coalesce("base_currency_candidates", F.array().cast("array<string>"))
    label = F.col("base_label")
    codes = F.concat(configured, F.array(label, A.ascii_currency_hex(label)))
    distinct = F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))
    return pairs.select("pair", F.explode(distinct).alias("base_currency"))


def resolve_pairs(swaps: DataFrame, candidates: DataFrame) -> DataFrame:
    """Most frequent (currency, issuer) per pair with a ``status``: resolved, ambiguous or absent.

    All pairs are counted in one job; rows combine to one count per candidate before they meet.
    """
    seen = orient_pair(swaps).groupBy("base_currency", "base_issuer").agg(F.count(F.lit(1)).alias("amm_rows"))
    ranked = candidates.join(seen, "base_currency").withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy("pair").orderBy(F.desc("amm_rows"), "base_currency", "base_issuer")
        ),
    )
    two = ranked.filter("_rank <= 2")
    best = two.groupBy("pair").agg(
        F.min_by(F.struct("base_currency", "base_issuer", "amm_rows"), "_rank").alias("best"),
        F.max(F.when(F.col("_rank") == 2, F.col("amm_rows"))).alias("_second"),
    )
    pairs = candidates.select("pair").distinct().join(best, "pair", "left")
    status = (
        F.when(F.col("best").isNull(), "absent")
        .when(F.col("_second") == F.col("best.amm_rows"), "ambiguous")
        .otherwise("resolved")
    )
    return pairs.select("pair", "best.*", status.alias("status"))


def reserve_range(swaps: DataFrame) -> DataFrame:
    """Smallest and largest reserve per asset class, with the number of pool accounts."""
    sides = swaps.select(
        "amm_account",
        F.inline(
            F.array(
                F.struct(
                    F.col("amm_asset_currency").alias("currency"),
                    F.col("amm_asset_balance_before").alias("balance"),
                ),
                F.struct(
                    F.col("amm_asset2_currency").alias("currency"),
                    F.col("amm_asset2_balance_before").alias("balance"),
                ),
            )
        ),
    )
    cls = F.when(F.coalesce("currency", F.lit("")) == NATIVE, "native").otherwise("token")
    value = F.col("balance").try_cast("decimal(38,18)")
    return (
        sides.select("amm_account", cls.alias("asset_class"), value.alias("reserve"))
        .groupBy("asset_class")
        .agg(
            F.min("reserve").alias("reserve_min"),
            F.max("reserve").alias("reserve_max"),
            F.count_distinct("amm_account").alias("pool_accounts"),
        )
    )


def token_activity(swaps: DataFrame, legs: DataFrame) -> DataFrame:
    """One row per (token, transaction) with venue flags and pool ledgers, ready to rank.

    Inputs carry (token, tx_hash, ledger_index). Rows combine per transaction before the token total.
    """
    rows = union_flagged(
        swaps.select("token", "tx_hash", "ledger_index"),
        legs.select("token", "tx_hash", "ledger_index"),
        ("has_amm", "has_clob"),
    )
    return rows.groupBy("token", "tx_hash").agg(
        F.max("has_amm").alias("has_amm"), F.max("has_clob").alias("has_clob")
    )


def rank_pairs(swaps: DataFrame, legs: DataFrame, n: int | None = None) -> DataFrame:
    """Tokens ranked by the smaller of their two venue counts, balance and overlap measures added."""
    per_tx = token_activity(swaps, legs)
    pool, book = F.count_if(F.col("has_amm") == 1), F.count_if(F.col("has_clob") == 1)
    both = F.count_if((F.col("has_amm") == 1) & (F.col("has_clob") == 1))
    counts = per_tx.groupBy("token").agg(
        pool.alias("amm_tx_count"), book.alias("clob_tx_count"), both.alias("overlap_tx_count")
    )
    ledgers = swaps.groupBy("token").agg(F.count_distinct("ledger_index").alias("amm_unique_ledger_count"))
    a, b = F.col("amm_tx_count"), F.col("clob_tx_count")
    low, high = F.least(a, b), F.greatest(a, b)
    measured = counts.join(ledgers, "token", "left").select(
        "token",
        (a + b - F.col("overlap_tx_count")).alias("dex_tx_count"),
        a.alias("amm_tx_count"),
        b.alias("clob_tx_count"),
        low.alias("both_sides_min_tx"),
        F.try_divide((2 * a * b).cast("double"), (a + b).cast("double")).alias("both_sides_hmean_tx"),
        F.try_divide(low.cast("double"), high.cast("double")).alias("balance_ratio"),
        "overlap_tx_count",
        F.try_divide(F.col("overlap_tx_count").cast("double"), low.cast("double")).alias("overlap_share_of_min"),
        F.coalesce("amm_unique_ledger_count", F.lit(0)).alias("amm_unique_ledger_count"),
    )
    ranked = global_rank(measured, ["-both_sides_min_tx", "-dex_tx_count", "token"], "rank")
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def pool_depth(swaps: DataFrame) -> DataFrame:
    """Reserve statistics per token, ranked by median native reserve.

    Input carries (token, native_reserve, token_reserve).
    """
    stats = swaps.groupBy("token").agg(
        F.count(F.lit(1)).alias("amm_rows"),
        *[
            fn(col).alias(f"{col}_{name}")
            for col in ("native_reserve", "token_reserve")
            for name, fn in (("min", F.min), ("mean", F.avg), ("max", F.max))
        ],
    )
    native = percentile_linear(swaps, ["token"], "native_reserve", {"native_reserve_median": 0.5})
    token = percentile_linear(swaps, ["token"], "token_reserve", {"token_reserve_median": 0.5})
    joined = stats.join(native.drop("n_values"), "token", "left").join(token.drop("n_values"), "token", "left")
    return global_rank(joined, ["-native_reserve_median", "token"], "depth_rank")


def ledger_cutoffs(required: DataFrame) -> DataFrame:
    """Largest needed index per ledger; a row without an index lifts the cutoff for its ledger."""
    open_end = F.max(F.col("transaction_index").isNull())
    return required.groupBy("ledger_index").agg(
        F.when(~open_end, F.max("transaction_index")).alias("max_index")
    )


def line_targets(meta: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Trust lines to fetch at each boundary: first offer-create per (boundary, owner, asset).

    ``meta`` rows carry resolved ids. The smallest index wins, a missing index counts as 10^9, and
    equal ones fall back to the hash.
    """
    r = F.col("result")
    issued = A.is_issued(r["TakerGets"])
    offers = meta.filter((r["TransactionType"] == "OfferCreate") & issued).select(
        "tx_hash", "ledger_index", "transaction_index", r["Account"].alias("owner_account"),
        A.currency_of(r["TakerGets"]).alias("currency"), A.issuer_of(r["TakerGets"]).alias("issuer"),
    )
    usable = F.col("owner_account").isNotNull() & F.col("currency").isNotNull() & (F.col("currency") != NATIVE) & (
        F.coalesce("issuer", F.lit("")) != ""
    )
    inside = F.col("max_index").isNull() | F.col("transaction_index").isNull() | (
        F.col("transaction_index") <= F.col("max_index")
    )
    kept = offers.filter(usable).join(cutoffs, "ledger_index").filter(inside)
    first = F.min(
        F.struct(
            F.coalesce("transaction_index", F.lit(1_000_000_000)).alias("_at"),
            F.col("tx_hash").alias("first_tx_hash"),
            F.col("transaction_index").alias("first_transaction_index"),
        )
    ).alias("f")
    keys = ["ledger_index", "owner_account", "currency", "issuer"]
    return kept.groupBy(*keys).agg(first).select(
        (F.col("ledger_index") - 1).alias("boundary_ledger_index"), "owner_account", "currency", "issuer",
        F.col("ledger_index").alias("first_target_ledger_index"),
        "f.first_transaction_index", "f.first_tx_hash",
    )


def offer_targets(books: DataFrame) -> DataFrame:
    """Distinct (ledger, account) whose open offers must be fetched; books are in long form."""
    return (
        books.select(F.col("used_prebook_ledger").alias("ledger_index"), "account")
        .filter("account is not null and account <> ''")
        .distinct()
    )


def tick_targets(meta: DataFrame, required: DataFrame) -> DataFrame:
    """Issuers of the offered assets per boundary ledger, each (ledger, issuer) once."""
    r = F.col("result")
    wanted = meta.join(required.select("tx_hash").distinct(), "tx_hash", "left_semi")
    offers = wanted.filter(F.upper(r["TransactionType"]) == "OFFERCREATE")
    issuers = F.explode(F.array(A.issuer_of(r["TakerGets"]), A.issuer_of(r["TakerPays"])))
    return (
        offers.select((F.col("ledger_index") - 1).alias("ledger_index"), issuers.alias("issuer"))
        .filter("issuer is not null and issuer <> ''")
        .distinct()
    )
