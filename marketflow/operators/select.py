"""Filters, projections and row classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.functions import labels as L
from marketflow.functions.constants import (
    CANONICAL_SIGNATURE,
    EPOCH_OFFSET,
    NATIVE,
    NATIVE_PATH_CURRENCY,
    OFFER_FILL_OR_KILL,
    OFFER_IMMEDIATE_OR_CANCEL,
    OFFER_PASSIVE,
    OFFER_SELL,
    PAYMENT_LIMIT_QUALITY,
    PAYMENT_NO_DIRECT,
    PAYMENT_PARTIAL,
)
from marketflow.sources.writers import with_reason


def window_filter(
    df: DataFrame,
    *,
    ledger: tuple[int | None, int | None] = (None, None),
    date: tuple[str | None, str | None] = (None, None),
    time: tuple[str | None, str | None] = (None, None),
    ledger_col: str = "ledger_index",
    date_col: str = "close_time_date",
    time_col: str = "close_time_datetime",
) -> DataFrame:
    """Ledger bounds include both ends; date and time ranges exclude their end."""
    if ledger[0] is not None:
        df = df.filter(F.col(ledger_col) >= ledger[0])
    if ledger[1] is not None:
        df = df.filter(F.col(ledger_col) <= ledger[1])
    if date[0]:
        df = df.filter(F.col(date_col) >= F.lit(date[0]).cast("date"))
    if date[1]:
        df = df.filter(F.col(date_col) < F.lit(date[1]).cast("date"))
    if time[0]:
        df = df.filter(F.col(time_col) >= F.lit(time[0]).cast("timestamp"))
    if time[1]:
        df = df.filter(F.col(time_col) < F.lit(time[1]).cast("timestamp"))
    return df


def _asset_is(currency: str, issuer: str, want: tuple[str, str]) -> Column:
    """Asset test in which a missing issuer equals the empty one."""
    return (F.col(currency) == want[0]) & (F.coalesce(F.col(issuer), F.lit("")) == want[1])


def _either_way(prefixes: tuple[str, str], base: tuple[str, str], counter: tuple[str, str]) -> Column:
    left, right = ((f"{p}_currency", f"{p}_issuer") for p in prefixes)
    return (_asset_is(*left, base) & _asset_is(*right, counter)) | (
        _asset_is(*left, counter) & _asset_is(*right, base)
    )


def pair_filter_swaps(df: DataFrame, base: tuple[str, str], counter: tuple[str, str] = (NATIVE, "")) -> DataFrame:
    """Swaps of a pool over {base, counter}, in either column order."""
    return df.filter(_either_way(("amm_asset", "amm_asset2"), base, counter))


def pair_filter_legs(df: DataFrame, base: tuple[str, str], counter: tuple[str, str] = (NATIVE, "")) -> DataFrame:
    """Legs of the pair by their offer columns or by their own columns, in either order."""
    return df.filter(
        _either_way(("offer_base", "offer_counter"), base, counter)
        | _either_way(("base", "counter"), base, counter)
    )


def orient_pair(df: DataFrame, counter: tuple[str, str] = (NATIVE, "")) -> DataFrame:
    """Add the asset that is not the counter as (base_currency, base_issuer); drop other pools."""
    first = _asset_is("amm_asset_currency", "amm_asset_issuer", counter)
    second = _asset_is("amm_asset2_currency", "amm_asset2_issuer", counter)
    return df.filter(first | second).withColumns(
        {
            "base_currency": F.when(first, F.col("amm_asset2_currency")).otherwise(F.col("amm_asset_currency")),
            "base_issuer": F.coalesce(
                F.when(first, F.col("amm_asset2_issuer")).otherwise(F.col("amm_asset_issuer")), F.lit("")
            ),
        }
    )


def normalise_keys(df: DataFrame) -> DataFrame:
    """Upper-case hash, numeric order keys, rows without a full key dropped."""
    return df.withColumns(
        {
            "tx_hash": F.upper(F.col("tx_hash").cast("string")),
            "ledger_index": F.col("ledger_index").try_cast("bigint"),
            "transaction_index": F.col("transaction_index").try_cast("bigint"),
        }
    ).dropna(subset=["tx_hash", "ledger_index", "transaction_index"])


def normalise_metadata(df: DataFrame) -> DataFrame:
    """``metaData`` becomes ``meta``, ledger fields default to the record's ledger, no hash no row."""
    ledger = F.coalesce("result.ledger_index", "ledger_index")
    result = (
        F.col("result")
        .withField("meta", F.coalesce("result.meta", "result.metaData"))
        .withField("ledger_index", ledger)
        .withField("inLedger", F.coalesce("result.inLedger", ledger))
        .withField("validated", F.coalesce("result.validated", F.lit(True)))
    )
    key = F.upper(F.coalesce("result.hash", "tx_hash"))
    return (
        df.withColumn("result", result.dropFields("metaData"))
        .withColumn("tx_hash", key)
        .withColumn("status", F.coalesce("status", F.lit("ok")))
        .filter("tx_hash is not null and tx_hash <> ''")
    )


def resolve_ids(df: DataFrame) -> DataFrame:
    """Add (ledger_index, transaction_index, tx_hash) from the alternative places of a record."""
    fields = df.schema["result"].dataType.fieldNames()
    metas = [m for m in ("meta", "metaData") if m in fields]
    return df.withColumns(
        {
            "ledger_index": F.coalesce(
                "result.ledger_index", "result.inLedger", *[f"result.{m}.ledger_index" for m in metas], "ledger_index"
            ),
            "transaction_index": F.coalesce(*[f"result.{m}.TransactionIndex" for m in metas]),
            "tx_hash": F.upper(F.coalesce("tx_hash", "result.hash")),
        }
    )


SELECTED = (
    "offercreate_pair_direct",
    "payment_pair_direct_no_paths",
    "payment_pair_direct_single_pair_local_path",
)


def select_targets(
    intents: DataFrame,
    *,
    base: str,
    counter: str = NATIVE,
    base_label: str,
    counter_label: str = NATIVE,
    utc_date: str | None = None,
) -> DataFrame:
    """Add (include, selection_reason, direction, utc_date) to intents; unknown types are an error."""
    kind = F.upper("transaction_type")
    c_in, c_out = F.col("in_currency"), F.col("out_currency")
    direct = ((c_in == counter) & (c_out == base)) | ((c_in == base) & (c_out == counter))
    reason = (
        F.when(~F.coalesce(direct, F.lit(False)), "non_pair_direct_intent")
        .when(kind == "OFFERCREATE", SELECTED[0])
        .when(kind == "PAYMENT",
            F.when(~F.col("paths_present"), SELECTED[1])
            .when(F.col("paths_external"), "payment_paths_external_asset")
            .when(F.col("paths_count") != 1, "payment_paths_not_single")
            .otherwise(SELECTED[2]))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported transaction type "), F.coalesce(kind, F.lit("?")))))
    )
    label = lambda c: F.when(c == counter, counter_label).otherwise(base_label)
    out = intents.withColumns(
        {
            "utc_date": F.to_date(F.timestamp_seconds(F.col("close_seconds") + EPOCH_OFFSET)),
            "selection_reason": reason,
            "direction": F.concat_ws("->", label(c_in), label(c_out)),
        }
    ).withColumn("include", F.col("selection_reason").isin(*SELECTED))
    return out if utc_date is None else out.filter(F.col("utc_date") == F.lit(utc_date).cast("date"))


def reason_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("selection_reason", "include").agg(F.count(F.lit(1)).alias("n"))


def build_intents(meta: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One typed intent per payment or offer-create record, with ``reject_reason`` for invalid ones.

    Input rows carry ``result`` with ids already resolved; ``keep`` names columns that stay beside the intent.
    """
    r = F.col("result")
    kind = F.upper(r["TransactionType"])
    payment, offer = kind == "PAYMENT", kind == "OFFERCREATE"
    flags = F.coalesce(r["Flags"], F.lit(0)).cast("bigint")
    deliver = F.coalesce(r["DeliverMax"], r["Amount"])
    raw = meta.filter(payment | offer).withColumns(
        {
            "_out": F.when(payment, deliver).otherwise(r["TakerPays"]),
            "_in": F.when(payment, F.coalesce(r["SendMax"], deliver)).otherwise(r["TakerGets"]),
            "_min": F.when(payment, r["DeliverMin"]),
        }
    )
    derived_issuer = F.when(A.is_issued(deliver), r["Account"])
    paths = r["Paths"]
    base = raw.select(
        "tx_hash",
        "ledger_index",
        "transaction_index",
        kind.alias("transaction_type"),
        flags.alias("flags"),
        r["Account"].alias("account"),
        r["date"].alias("close_seconds"),
        A.parse_amount("_in").alias("in_amount"),
        A.parse_amount("_out").alias("out_amount"),
        A.currency_of(F.col("_in")).alias("in_currency"),
        F.when(payment & r["SendMax"].isNull(), derived_issuer).otherwise(A.issuer_of(F.col("_in"))).alias("in_issuer"),
        A.currency_of(F.col("_out")).alias("out_currency"),
        A.issuer_of(F.col("_out")).alias("out_issuer"),
        A.parse_amount("_min").alias("min_amount"),
        F.col("_min").isNotNull().alias("has_min"),
        A.asset_key(F.col("_min")).alias("_min_asset"),
        (payment & L.has_flag(flags, PAYMENT_PARTIAL)).alias("partial_allowed"),
        (payment & L.has_flag(flags, PAYMENT_NO_DIRECT)).alias("no_direct"),
        (payment & L.has_flag(flags, PAYMENT_LIMIT_QUALITY)).alias("limit_quality"),
        (payment & paths.isNotNull()).alias("paths_present"),
        F.when(payment & paths.isNotNull(), F.size(paths)).otherwise(F.lit(0)).cast("bigint").alias("paths_count"),
        (offer & L.has_flag(flags, OFFER_SELL)).alias("is_sell"),
        (offer & L.has_flag(flags, OFFER_IMMEDIATE_OR_CANCEL)).alias("is_ioc"),
        (offer & L.has_flag(flags, OFFER_FILL_OR_KILL)).alias("is_fok"),
        (offer & L.has_flag(flags, OFFER_PASSIVE)).alias("is_passive"),
        F.when(offer, r["OfferSequence"]).alias("cancel_sequence"),
        paths.alias("_paths"),
        *keep,
    )
    known = F.array(F.col("in_currency"), F.col("out_currency"), F.lit(NATIVE), F.lit(NATIVE_PATH_CURRENCY))
    external = F.exists(
        F.flatten("_paths"), lambda s: s["currency"].isNotNull() & ~F.array_contains(known, s["currency"])
    )
    is_pay = F.col("transaction_type") == "PAYMENT"
    pay_bits = PAYMENT_PARTIAL | PAYMENT_NO_DIRECT | PAYMENT_LIMIT_QUALITY | CANONICAL_SIGNATURE
    offer_bits = OFFER_PASSIVE | OFFER_IMMEDIATE_OR_CANCEL | OFFER_FILL_OR_KILL | OFFER_SELL | CANONICAL_SIGNATURE
    foreign = F.col("flags").bitwiseAND(F.bitwise_not(F.when(is_pay, F.lit(pay_bits)).otherwise(F.lit(offer_bits))))
    out_asset = F.concat_ws(":", F.col("out_currency"), F.coalesce("out_issuer", F.lit("")))
    in_asset = F.concat_ws(":", F.col("in_currency"), F.coalesce("in_issuer", F.lit("")))
    minimum, most = F.col("min_amount"), F.col("out_amount")
    above = (minimum["exponent"] > most["exponent"]) | (
        (minimum["exponent"] == most["exponent"]) & (minimum["units"] > most["units"])
    )
    checks = {
        "conflicting_flags": ~(F.col("is_ioc") & F.col("is_fok")),
        "unsupported_flags": foreign == 0,
        "invalid_amount": F.coalesce(F.col("in_amount.units") > 0, F.lit(False))
        & F.coalesce(F.col("out_amount.units") > 0, F.lit(False)),
        "minimum_without_partial": ~F.col("has_min") | F.col("partial_allowed"),
        "minimum_asset_mismatch": ~F.col("has_min") | (F.col("_min_asset") == out_asset),
        "minimum_above_maximum": ~F.col("has_min") | ~above,
        "same_asset": is_pay | (in_asset != out_asset),
        "invalid_cancel_sequence": F.col("cancel_sequence").isNull() | (F.col("cancel_sequence") > 0),
    }
    equal = (
        F.col("has_min") & (minimum["exponent"] == most["exponent"]) & (minimum["units"] == most["units"])
    )
    built = base.withColumn("paths_external", F.coalesce(external, F.lit(False))).withColumn(
        "min_equals_max", F.coalesce(equal, F.lit(False))
    )
    return with_reason(built, checks).drop("_paths", "_min_asset")


def intent_records(meta: DataFrame) -> DataFrame:
    """Records with a valid intent, its columns beside ``result``: what reads both needs no join."""
    built = A.computed(build_intents(meta, keep=("result",)), {"_valid": "reject_reason is null"})
    return built.filter("_valid").drop("_valid", "reject_reason")


def intent_modes(intents: DataFrame) -> DataFrame:
    """Add the intent mode and the side the intent fixes."""
    sized = F.col("in_amount").isNotNull() & F.col("out_amount").isNotNull()
    return intents.withColumns(
        {
            "intent_mode": L.intent_mode(F.col("transaction_type"), F.col("is_sell"), F.col("partial_allowed")),
            "intent_family": L.intent_family(
                F.col("transaction_type"), F.col("is_sell"), F.col("is_fok"),
                F.col("partial_allowed"), F.col("min_equals_max"), sized,
            ),
        }
    )


def prediction_roles(intents: DataFrame) -> DataFrame:
    """Add prediction_role, predicted_side and constraint_side."""
    role = L.prediction_role(
        F.col("transaction_type"), F.col("is_sell"), F.col("is_fok"),
        F.col("partial_allowed"), F.col("min_equals_max"),
    )
    return intents.withColumn("_role", role).select("*", "_role.*").drop("_role")


def select_outliers(df: DataFrame, threshold: float, keys: DataFrame | None = None) -> DataFrame:
    """Rows listed in ``keys`` or whose larger absolute total difference exceeds ``threshold``.

    ``df`` carries tx_hash, total_in_diff, total_out_diff and ``version``; the highest version of a
    hash wins.
    """
    zero = F.lit(0)
    size = F.greatest(
        F.abs(F.coalesce("total_in_diff", zero)), F.abs(F.coalesce("total_out_diff", zero))
    ).cast("double")
    rated = df.withColumn("tx_hash", F.upper(F.trim("tx_hash"))).withColumn("magnitude", size)
    keep = F.col("magnitude") > threshold
    if keys is not None:
        listed = keys.select(F.upper(F.trim("tx_hash")).alias("tx_hash")).distinct()
        rated = rated.join(listed.withColumn("_listed", F.lit(True)), "tx_hash", "left")
        keep = keep | F.coalesce(F.col("_listed"), F.lit(False))
    kept = rated.filter(keep).drop("_listed")
    packed = F.struct(*[c for c in kept.columns if c != "tx_hash"])
    newest = kept.groupBy("tx_hash").agg(F.max_by(packed, F.col("version")).alias("_r"))
    return newest.select("tx_hash", "_r.*")


def clean_book(book: DataFrame, intents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove offers an intent may not meet.

    ``book`` has (tx_hash, offer_id, account, sequence, taker_gets_funded, taker_pays_funded);
    ``deleted`` lists (tx_hash, offer_id) removed without a fill; funded columns hold numbers.
    """
    who = intents.select(
        "tx_hash", F.col("account").alias("_taker"), F.col("cancel_sequence").alias("_cancel"),
        (F.col("transaction_type") == "OFFERCREATE").alias("_offer"),
    )
    gone = deleted.select("tx_hash", "offer_id").distinct().withColumn("_gone", F.lit(True))
    own = F.col("account") == F.col("_taker")
    cancelled = F.coalesce(F.col("_offer") & own & (F.col("sequence") == F.col("_cancel")), F.lit(False))
    is_gone = F.coalesce(F.col("_gone"), F.lit(False))
    funded = F.coalesce(F.col("taker_gets_funded") > 0, F.lit(True)) & F.coalesce(
        F.col("taker_pays_funded") > 0, F.lit(True)
    )
    return (
        book.join(who, "tx_hash", "left")
        .join(gone, ["tx_hash", "offer_id"], "left")
        .filter(~cancelled & funded & (~is_gone | F.coalesce(own, F.lit(False))))
        .withColumn("non_fill_deleted", is_gone)
        .drop("_taker", "_cancel", "_offer", "_gone")
    )


def extract_cases(results: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Result rows of the listed hashes, and the listed hashes without any row."""
    wanted = keys.select(F.upper(F.trim("tx_hash")).alias("tx_hash")).distinct()
    rows = results.withColumn("tx_hash", F.upper("tx_hash"))
    return rows.join(wanted, "tx_hash", "left_semi"), wanted.join(rows, "tx_hash", "left_anti")


def classify_side(offers: DataFrame, asset: tuple[str, str]) -> DataFrame:
    """Label native <-> asset offers with the side they give; other offers are dropped."""
    gets, pays = F.col("taker_gets"), F.col("taker_pays")
    is_asset = lambda raw: (A.currency_of(raw) == asset[0]) & (A.issuer_of(raw) == asset[1])
    is_native = lambda raw: A.currency_of(raw) == NATIVE
    side = F.when(is_native(gets) & is_asset(pays), "gets_native").when(
        is_asset(gets) & is_native(pays), "gets_issued"
    )
    return offers.withColumn("side", side).filter("side is not null")
