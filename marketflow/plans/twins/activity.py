"""Pair activity, selection and intents."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import keys as K
from marketflow.operators import pairs as P
from marketflow.operators import select as S
from marketflow.plans import derive as D
from marketflow.plans.twins.base import BOOK, book_rows
from marketflow.plans.twins.common import INTENTS, LEGS, META, ORDERS, SEQUENCE, SWAPS, n, plain, r, sql

BASE = ("T1", "I1")


def tx_sequence(spark, root):
    return plain(P.tx_sequence(D.swaps(spark, root), D.legs(spark, root)))


def ordered_sequence(spark, root):
    return plain(P.ordered(P.tx_sequence(D.swaps(spark, root), D.legs(spark, root))))


def venue_composition(spark, root):
    return P.venue_composition(P.tx_sequence(D.swaps(spark, root), D.legs(spark, root)))


def sequence_stats(spark, root):
    return plain(P.sequence_stats(P.tx_sequence(D.swaps(spark, root), D.legs(spark, root))))


def ledger_activity(spark, root):
    return plain(P.ledger_activity(D.swaps(spark, root)))


def resolve_pairs(spark, root):
    swaps = D.swaps(spark, root)
    pairs = swaps.select(F.col("token").alias("pair"), F.col("token").alias("base_label"), F.lit(None).cast("array<string>").alias("base_currency_candidates")).distinct()
    return P.resolve_pairs(swaps, P.currency_candidates(pairs))


def currency_candidates(spark, root):
    c = D.table(spark, root, "customer").select(F.col("c_name").alias("pair"), F.col("c_name").alias("base_label"), F.array("c_mktsegment", "c_name").alias("base_currency_candidates"))
    return P.currency_candidates(c)


def reserve_range(spark, root):
    return plain(P.reserve_range(D.swaps(spark, root)))


def rank_pairs(spark, root):
    return plain(P.rank_pairs(D.swaps(spark, root).withColumn("tx_hash", F.upper("tx_hash")), D.legs(spark, root)))


def pool_depth(spark, root):
    return plain(P.pool_depth(D.swaps(spark, root)), 4)


def _required(spark, root):
    ti = F.when((F.col("k") % 10 == 3) & (D.div("k", 10) % 4 == 0), F.lit(None)).otherwise(F.col("k") % 10)
    return D.orders(spark, root).filter("c % 3 = 0").select(D.div("k", 10).alias("ledger_index"), ti.alias("transaction_index"))


def ledger_cutoffs(spark, root):
    return P.ledger_cutoffs(_required(spark, root))


def line_targets(spark, root):
    return plain(P.line_targets(D.metadata_heads(spark, root), P.ledger_cutoffs(_required(spark, root))))


def offer_targets(spark, root):
    return P.offer_targets(book_rows(spark, root).withColumnRenamed("ledger_index", "used_prebook_ledger"))


def tick_targets(spark, root):
    required = D.orders(spark, root).filter("c % 2 = 0").select(D.tagged("A", F.col("k")).alias("tx_hash"))
    return P.tick_targets(D.metadata_heads(spark, root), required)


def pair_filter_swaps(spark, root):
    return plain(S.pair_filter_swaps(D.swaps(spark, root), BASE).select("tx_hash", "ledger_index"))


def pair_filter_legs(spark, root):
    kept = S.pair_filter_legs(D.legs(spark, root), BASE)
    return plain(kept.groupBy("tx_hash").agg(F.count(F.lit(1)).alias("n")))


def orient_pair(spark, root):
    return S.orient_pair(D.swaps(spark, root)).select("tx_hash", "base_currency", "base_issuer")


def normalise_keys(spark, root):
    ev = D.table(spark, root, "events")
    odd = F.col("event_id") % 7 == 0
    rows = ev.select(F.concat("event_type", F.col("event_id").cast("string")).alias("tx_hash"),
                     F.when(odd, F.lit("x")).otherwise(F.get_json_object("props", "$.k")).alias("ledger_index"),
                     F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("transaction_index"))
    return S.normalise_keys(rows)


def metadata_ids(spark, root):
    """Normalised records: hash, ledger and index from wherever the record holds them."""
    meta = D.metadata_heads(spark, root)
    return plain(meta.select("tx_hash", "ledger_index", "transaction_index", "status", F.col("result.inLedger").alias("in_ledger"), F.col("result.validated").alias("validated")))


def build_intents(spark, root):
    it = D.intents(spark, root)
    return plain(it.select(
        "tx_hash", "ledger_index", "transaction_index", "transaction_type", "flags", "account", "in_currency", "in_issuer", "out_currency", "out_issuer",
        F.col("in_amount.value").alias("in_value"), F.col("out_amount.value").alias("out_value"), F.col("min_amount.value").alias("min_value"),
        "partial_allowed", "no_direct", "limit_quality", "paths_present", "paths_count", "paths_external", "is_sell", "is_ioc", "is_fok", "is_passive",
        "cancel_sequence", "has_min", "min_equals_max"))


def rejected_intents(spark, root):
    raw = D.landed(spark, root, "intents", D._intents)
    return raw.groupBy("transaction_type", F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _targets(spark, root):
    return S.select_targets(D.intents(spark, root), base=BASE[0], base_label="tok")


def select_targets(spark, root):
    return plain(_targets(spark, root).select("tx_hash", "include", "selection_reason", "direction", "utc_date"))


def targets_on_day(spark, root):
    kept = S.select_targets(D.intents(spark, root), base=BASE[0], base_label="tok", utc_date="1996-05-20")
    return kept.select("tx_hash", "direction")


def reason_counts(spark, root):
    return S.reason_counts(_targets(spark, root))


def intent_modes(spark, root):
    return D.intents(spark, root).select("tx_hash", "intent_mode", "intent_family")


def prediction_roles(spark, root):
    return D.intents(spark, root).select("tx_hash", "prediction_role", "predicted_side", "constraint_side")


def select_outliers(spark, root):
    li = D.table(spark, root, "lineitem")
    rows = li.select(D.tagged("x", F.col("l_orderkey")).alias("tx_hash"), (F.col("l_quantity") - 25).alias("total_in_diff"), (F.col("l_discount") * 300).alias("total_out_diff"),
                     F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("version"))
    keys = D.table(spark, root, "orders").filter("o_totalprice < 5000").select(D.tagged("X", F.col("o_orderkey")).alias("tx_hash"))
    return plain(S.select_outliers(rows, 24.0, keys).select("tx_hash", "magnitude", "total_in_diff"))


def clean_book(spark, root):
    """Boundary offers met by the order five keys later, cancelled and deleted ones removed."""
    book = book_rows(spark, root)
    met = book.select(D.tagged("A", F.col("k") + 5).alias("tx_hash"), "offer_id", F.when(F.col("k") % 6 == 1, D.tagged("U", F.col("u") % 50)).otherwise(F.col("account")).alias("account"),
                      F.when(F.col("k") % 6 == 1, F.col("k") + 5).otherwise(F.col("k")).alias("sequence"),
                      F.when(F.col("k") % 7 == 0, F.col("k") % 2).cast("double").alias("taker_gets_funded"), F.lit(None).cast("double").alias("taker_pays_funded"))
    who = D.orders(spark, root).select(D.tagged("A", F.col("k")).alias("tx_hash"), D.tagged("U", F.col("u") % 50).alias("account"), F.when(F.col("k") % 6 == 0, F.col("k")).alias("cancel_sequence"),
                                       F.when(F.col("k") % 5 < 3, "OFFERCREATE").otherwise("PAYMENT").alias("transaction_type"))
    deleted = book.filter("k % 4 = 0").select(D.tagged("A", F.col("k") + 5).alias("tx_hash"), "offer_id")
    return S.clean_book(met, who, deleted).select("tx_hash", "offer_id", "non_fill_deleted")


def extract_cases(spark, root):
    keys = D.orders(spark, root).filter("c % 5 = 0").select(D.tagged("a", F.col("k") * 2).alias("tx_hash"))
    rows = D.swaps(spark, root).select("tx_hash", "ledger_index")
    found, lost = S.extract_cases(rows, keys)
    return found.select("tx_hash", F.lit("found").alias("status")).unionByName(lost.select("tx_hash", F.lit("missing").alias("status")))


def classify_side(spark, root):
    return S.classify_side(book_rows(spark, root), BASE).select("offer_id", "side")


def join_required(spark, root):
    li = D.table(spark, root, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    orders = D.table(spark, root, "orders").select(F.col("o_orderkey").alias("key"))
    return K.join_required(orders, li, ["key"], strict=False).select("key", "n", "matched")


def target_composition(spark, root):
    """Venue composition of the selected targets; every target must be in the sequence."""
    seq = P.tx_sequence(D.swaps(spark, root), D.legs(spark, root)).select("tx_hash", "has_amm", "has_clob")
    targets = _targets(spark, root).filter("include").select("tx_hash")
    return P.venue_composition(K.join_required(targets, seq, ["tx_hash"]))


def check_keys(spark, root):
    orders = D.table(spark, root, "orders").select(F.col("o_orderkey").alias("key"))
    li = D.table(spark, root, "lineitem").select(F.col("l_orderkey").alias("key"))
    return K.check_keys(orders, li, ["key"]).select("problem", "n")


def attach_metadata(spark, root):
    targets = D.swaps(spark, root).filter("transaction_index < 4").select(F.upper("tx_hash").alias("tx_hash"), "ledger_index")
    meta = D.metadata_heads(spark, root).select("tx_hash", "ledger_index", "transaction_index", "result")
    return K.attach_metadata(targets, meta).select("tx_hash", "ledger_index", "metadata_ledger_index", F.col("result.TransactionType").alias("kind"))


def keep_targets(spark, root):
    targets = D.orders(spark, root).filter("c % 10 = 0").select(F.col("k").alias("l_orderkey"))
    return plain(K.keep_targets(D.table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), targets, "l_orderkey"))


def pending(spark, root):
    """Parts a supplier still has to be asked for, gathered per supplier group."""
    li = D.table(spark, root, "lineitem")
    todo = li.select((F.col("l_partkey") % 997).alias("part"), F.col("l_suppkey").alias("supp"))
    done = li.filter("l_quantity > 30").select((F.col("l_partkey") % 997).alias("part"), F.col("l_suppkey").alias("supp"))
    out = K.pending(todo, done, ["part", "supp"], ["supp"], "part")
    return out.select("supp", F.array_join("items", ",").alias("items"))


def attach_book_side(spark, root):
    """Intents with the offer of the next key on the side that gives their output."""
    books = book_rows(spark, root).select(D.tagged("A", F.col("k") - 1).alias("tx_hash"), "side", "offer_id")
    return K.attach_book_side(D.intents(spark, root), books).select("tx_hash", "side", "offer_id")


def pair_parameters(spark, root):
    """Nations broadcast to customers as per-pair parameters."""

    nation = D.table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    c = D.table(spark, root, "customer").select("c_custkey", "c_nationkey")
    return plain(c.join(nation, "c_nationkey").select("c_custkey", "n_name", "n_regionkey"))


def attach_fee(spark, root):
    fees = D.fees(spark, root).filter("tx_hash not like '%7'").withColumn("tx_hash", F.upper("tx_hash")).select("tx_hash", "trading_fee")
    swaps = D.swaps(spark, root).select(F.upper("tx_hash").alias("tx_hash"), "asset_in_currency", "asset_out_currency")
    return K.attach_fee(swaps, fees, D.intents(spark, root)).select("tx_hash", F.coalesce("problem", F.lit("ok")).alias("problem"))


def fill_lines(spark, root):
    targets = D.orders(spark, root).select(D.div("k", 10).alias("ledger_index"), D.tagged("U", F.col("u") % 50).alias("owner_account"), D.tagged("I", F.col("u") % 3).alias("issuer"), D.tagged("T", F.col("u") % 7).alias("currency"))
    lines = D.orders(spark, root).filter("c % 3 = 0").select(D.div("k", 10).alias("ledger_index"), D.tagged("U", F.col("u") % 50).alias("owner_account"), D.tagged("I", F.col("u") % 3).alias("issuer"), D.tagged("T", F.col("u") % 7).alias("currency"), F.lpad(F.col("c").cast("string"), 12, "0").alias("balance"))
    return K.fill_lines(targets, lines).withColumn("problem", F.coalesce("problem", F.lit("ok")))


DIRECT = "((icur = 'XRP' AND ocur = 'T1') OR (icur = 'T1' AND ocur = 'XRP'))"
REASON = (
    f"CASE WHEN NOT {DIRECT} THEN 'non_pair_direct_intent' WHEN offer THEN 'offercreate_pair_direct' "
    "WHEN NOT has_paths THEN 'payment_pair_direct_no_paths' WHEN ext THEN 'payment_paths_external_asset' "
    "WHEN n_paths <> 1 THEN 'payment_paths_not_single' ELSE 'payment_pair_direct_single_pair_local_path' END"
)
TARGETS = (
    INTENTS + f", tg0 AS (SELECT *, {REASON} reason FROM it), tg AS (SELECT *, reason IN ('offercreate_pair_direct', "
    "'payment_pair_direct_no_paths', 'payment_pair_direct_single_pair_local_path') incl, "
    "CASE WHEN icur = 'XRP' THEN 'XRP' ELSE 'tok' END || '->' || CASE WHEN ocur = 'XRP' THEN 'XRP' ELSE 'tok' END dir FROM tg0)"
)
SEQUENCE_TAIL = SEQUENCE.removeprefix(ORDERS)
COMPOSITION = "count(*) transactions, count(*) FILTER (has_amm > 0) amm, count(*) FILTER (has_clob > 0) clob, count(*) FILTER (has_amm > 0 AND has_clob > 0) amm_clob"
SEQ_COLS = f"tx_hash, ledger_index, transaction_index, {n('has_amm')} has_amm, {n('has_clob')} has_clob, {n('ledger_index <> li2')} ledger_mismatch, {n('transaction_index <> ti2')} txi_mismatch"
REQUIRED = "req AS (SELECT k // 10 li, CASE WHEN k % 10 = 3 AND (k // 10) % 4 = 0 THEN NULL ELSE k % 10 END ti FROM o WHERE c % 3 = 0), cut AS (SELECT li, CASE WHEN bool_or(ti IS NULL) THEN NULL ELSE max(ti) END mx FROM req GROUP BY 1)"
ROLE = (
    "CASE WHEN offer AND fok AND sell THEN 'offer_fok_sell_input_target_output_predicted' WHEN offer AND fok THEN 'offer_fok_buy_output_target_input_predicted' "
    "WHEN offer THEN 'offer_limit_order_crossing_both_computed' WHEN NOT partial THEN 'payment_full_output_target_input_predicted' "
    "WHEN min_max THEN 'payment_partial_exact_output_target_input_predicted' ELSE 'payment_partial_dual_constraint_both_computed' END"
)
PREDICTED = "CASE WHEN offer AND fok AND sell THEN 'out' WHEN (offer AND fok) OR (pay AND (NOT partial OR min_max)) THEN 'in' END"
CONSTRAINT = "CASE WHEN offer AND fok AND sell THEN 'in' WHEN (offer AND fok) OR (pay AND (NOT partial OR min_max)) THEN 'out' END"
MODE = "CASE WHEN offer THEN CASE WHEN sell THEN 'offer_sell' ELSE 'offer_buy' END ELSE CASE WHEN partial THEN 'payment_partial' ELSE 'payment_full' END END"

TWINS = {
    "tx_sequence": (tx_sequence, sql(SEQUENCE, f"SELECT {SEQ_COLS} FROM seq")),
    "ordered_sequence": (ordered_sequence, sql(SEQUENCE, f"SELECT {SEQ_COLS} FROM seq ORDER BY ledger_index, transaction_index, tx_hash")),
    "venue_composition": (venue_composition, sql(SEQUENCE, f"SELECT {COMPOSITION} FROM seq")),
    "sequence_stats": (sequence_stats, sql(SEQUENCE, "SELECT count(*) tx_unique, count(*) FILTER (has_amm = 1) tx_has_amm, count(*) FILTER (has_clob = 1) tx_has_clob, "
        "count(*) FILTER (has_amm = 1 AND has_clob = 1) tx_has_both, count(*) FILTER (ledger_index <> li2) ledger_mismatch_txs, count(*) FILTER (transaction_index <> ti2) txi_mismatch_txs, "
        "min(ledger_index) ledger_min, max(ledger_index) ledger_max, count(DISTINCT ledger_index) prebook_unique_ledgers FROM seq")),
    "ledger_activity": (ledger_activity, sql(SWAPS, "SELECT li ledger_index, count(*) amm_swap_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') amm_first_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') amm_last_time, min(ti) amm_min_tx_index, max(ti) amm_max_tx_index FROM sw GROUP BY 1")),
    "resolve_pairs": (resolve_pairs, sql(SWAPS, "SELECT pair, base_currency, base_issuer, amm_rows, CASE WHEN nxt = amm_rows THEN 'ambiguous' ELSE 'resolved' END status FROM (SELECT token pair, token base_currency, issuer base_issuer, amm_rows, "
        "row_number() OVER w rk, lead(amm_rows) OVER w nxt FROM (SELECT token, issuer, count(*) amm_rows FROM sw GROUP BY 1, 2) WINDOW w AS (PARTITION BY token ORDER BY amm_rows DESC, issuer)) WHERE rk = 1")),
    "currency_candidates": (currency_candidates, "SELECT c_name pair, unnest([c_mktsegment, c_name] || CASE WHEN length(c_name) <= 20 THEN [rpad(upper(hex(c_name)), 40, '0')] ELSE [] END) base_currency FROM customer"),
    "reserve_range": (reserve_range, sql(SWAPS, f"SELECT 'native' asset_class, {r('min(nres)')} reserve_min, {r('max(nres)')} reserve_max, count(DISTINCT pool) pool_accounts FROM sw UNION ALL SELECT 'token', {r('min(tres)')}, {r('max(tres)')}, count(DISTINCT pool) FROM sw")),
    "rank_pairs": (rank_pairs, sql(SWAPS + ", " + LEGS, ", t AS (SELECT token, tx, max(a) a, max(b) b FROM (SELECT token, upper(tx) tx, 1 a, 0 b FROM sw UNION ALL SELECT token, tx, 0, 1 FROM lg) GROUP BY 1, 2), "
        "q AS (SELECT token, sum(a) a, sum(b) b, sum(a * b) o FROM t GROUP BY 1), l AS (SELECT token, count(DISTINCT li) ul FROM sw GROUP BY 1) "
        f"SELECT token, {n('a + b - o')} dex_tx_count, {n('a')} amm_tx_count, {n('b')} clob_tx_count, {n('least(a, b)')} both_sides_min_tx, {r('2.0 * a * b / (a + b)')} both_sides_hmean_tx, "
        f"{r('CAST(least(a, b) AS DOUBLE) / greatest(a, b)')} balance_ratio, {n('o')} overlap_tx_count, {r('CAST(o AS DOUBLE) / least(a, b)')} overlap_share_of_min, {n('coalesce(ul, 0)')} amm_unique_ledger_count, "
        f"{n('row_number() OVER (ORDER BY least(a, b) DESC, a + b - o DESC, token)')} AS rank FROM q LEFT JOIN l USING (token)")),
    "pool_depth": (pool_depth, sql(SWAPS, f", q AS (SELECT token, count(*) amm_rows, min(nres) a1, avg(nres) a2, max(nres) a3, quantile_cont(nres, 0.5) a4, min(tres) b1, avg(tres) b2, max(tres) b3, quantile_cont(tres, 0.5) b4 FROM sw GROUP BY 1) "
        f"SELECT token, amm_rows, {r('a1', 4)} native_reserve_min, {r('a2', 4)} native_reserve_mean, {r('a3', 4)} native_reserve_max, {r('b1', 4)} token_reserve_min, {r('b2', 4)} token_reserve_mean, {r('b3', 4)} token_reserve_max, "
        f"{r('a4', 4)} native_reserve_median, {r('b4', 4)} token_reserve_median, {n('row_number() OVER (ORDER BY a4 DESC, token)')} depth_rank FROM q")),
    "ledger_cutoffs": (ledger_cutoffs, sql(META, f", {REQUIRED} SELECT li ledger_index, mx max_index FROM cut")),
    "line_targets": (line_targets, sql(META, f", {REQUIRED}, q AS (SELECT m.*, row_number() OVER (PARTITION BY m.li, who, cur, iss ORDER BY m.ti, tx) rk FROM m JOIN cut ON m.li = cut.li WHERE offer AND NOT nin AND (mx IS NULL OR m.ti <= mx)) "
        "SELECT li - 1 boundary_ledger_index, who owner_account, cur currency, iss issuer, li first_target_ledger_index, ti first_transaction_index, tx first_tx_hash FROM q WHERE rk = 1")),
    "offer_targets": (offer_targets, sql(BOOK, "SELECT DISTINCT li ledger_index, account FROM bk")),
    "tick_targets": (tick_targets, sql(META, "SELECT DISTINCT li - 1 ledger_index, iss issuer FROM m WHERE offer AND c % 2 = 0")),
    "pair_filter_swaps": (pair_filter_swaps, sql(SWAPS, "SELECT tx tx_hash, li ledger_index FROM sw WHERE token = 'T1' AND issuer = 'I1'")),
    "pair_filter_legs": (pair_filter_legs, sql(LEGS, "SELECT tx tx_hash, count(*) n FROM lg WHERE token = 'T1' AND issuer = 'I1' GROUP BY 1")),
    "orient_pair": (orient_pair, sql(SWAPS, "SELECT tx tx_hash, token base_currency, issuer base_issuer FROM sw")),
    "normalise_keys": (normalise_keys, "SELECT upper(event_type || event_id) tx_hash, CAST(json_extract_string(props, '$.k') AS BIGINT) ledger_index, user_id transaction_index FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL"),
    "metadata_ids": (metadata_ids, sql(META, "SELECT tx tx_hash, li ledger_index, ti transaction_index, 'ok' status, CASE WHEN k % 2 = 1 THEN li ELSE li END in_ledger, true validated FROM m")),
    "build_intents": (build_intents, sql(INTENTS, "SELECT tx tx_hash, li ledger_index, ti transaction_index, tt transaction_type, "
        "CASE WHEN pay THEN CAST(b10 AS BIGINT) * 131072 + CAST(b20 AS BIGINT) * 65536 + CAST(b40 AS BIGINT) * 262144 ELSE CAST(b10 AS BIGINT) * 524288 + CASE turn WHEN 1 THEN 131072 WHEN 2 THEN 262144 ELSE 0 END END flags, "
        f"who account, icur in_currency, iiss in_issuer, ocur out_currency, oiss out_issuer, {r('ival')} in_value, {r('oval')} out_value, {r('CASE WHEN min_max THEN oval WHEN has_min THEN oval / 2 END')} min_value, "
        "partial partial_allowed, no_direct, lq limit_quality, has_paths paths_present, CAST(n_paths AS BIGINT) paths_count, ext paths_external, sell is_sell, ioc is_ioc, fok is_fok, false is_passive, cancel cancel_sequence, has_min, min_max min_equals_max FROM it")),
    "rejected_intents": (rejected_intents, sql(META, "SELECT CASE WHEN pay THEN 'PAYMENT' ELSE 'OFFERCREATE' END transaction_type, CASE WHEN offer AND turn = 3 THEN 'conflicting_flags' WHEN offer AND k % 6 = 0 AND k = 0 THEN 'invalid_cancel_sequence' ELSE 'ok' END reason, count(*) n FROM m WHERE pay OR offer GROUP BY 1, 2")),
    "select_targets": (select_targets, sql(TARGETS, "SELECT tx tx_hash, incl include, reason selection_reason, dir direction, CAST(d AS VARCHAR) utc_date FROM tg")),
    "targets_on_day": (targets_on_day, sql(TARGETS, "SELECT tx tx_hash, dir direction FROM tg WHERE d = DATE '1996-05-20'")),
    "reason_counts": (reason_counts, sql(TARGETS, "SELECT reason selection_reason, incl include, count(*) n FROM tg GROUP BY 1, 2")),
    "intent_modes": (intent_modes, sql(INTENTS, f"SELECT tx tx_hash, {MODE} intent_mode, CASE WHEN offer THEN CASE WHEN sell AND fok THEN 'fixed_input' WHEN fok THEN 'fixed_output' ELSE 'bounded_partial' END ELSE CASE WHEN partial AND NOT min_max THEN 'bounded_partial' ELSE 'fixed_output' END END intent_family FROM it")),
    "prediction_roles": (prediction_roles, sql(INTENTS, f"SELECT tx tx_hash, {ROLE} prediction_role, {PREDICTED} predicted_side, {CONSTRAINT} constraint_side FROM it")),
    "select_outliers": (select_outliers, "WITH q AS (SELECT 'X' || l_orderkey tx_hash, l_quantity - 25 a, l_discount * 300 b, (l_shipdate, l_partkey, l_suppkey, l_extendedprice) v, greatest(abs(l_quantity - 25), abs(l_discount * 300)) mag FROM lineitem), "
        "f AS (SELECT * FROM q WHERE mag > 24 OR tx_hash IN (SELECT 'X' || o_orderkey FROM orders WHERE o_totalprice < 5000)), "
        f"g AS (SELECT *, row_number() OVER (PARTITION BY tx_hash ORDER BY v DESC) rk FROM f) SELECT tx_hash, {r('mag')} magnitude, {r('a')} total_in_diff FROM g WHERE rk = 1"),
    "clean_book": (clean_book, sql(BOOK, ", w AS (SELECT 'A' || k tx, 'U' || (u % 50) taker, CASE WHEN k % 6 = 0 THEN k END cancel, k % 5 < 3 offer FROM o), "
        "b AS (SELECT 'A' || (k + 5) tx, offer_id, CASE WHEN k % 6 = 1 THEN 'U' || (u % 50) ELSE account END acc, CASE WHEN k % 6 = 1 THEN k + 5 ELSE k END seq, CASE WHEN k % 7 = 0 THEN k % 2 END funded, k % 4 = 0 gone FROM bk) "
        "SELECT b.tx tx_hash, offer_id, gone non_fill_deleted FROM b LEFT JOIN w ON b.tx = w.tx WHERE NOT coalesce(offer AND acc = taker AND seq = cancel, false) AND coalesce(funded > 0, true) AND (NOT gone OR coalesce(acc = taker, false))")),
    "extract_cases": (extract_cases, sql(SWAPS, ", q AS (SELECT DISTINCT 'A' || (k * 2) tx FROM o WHERE c % 5 = 0) SELECT q.tx tx_hash, CASE WHEN s.tx IS NULL THEN 'missing' ELSE 'found' END status FROM q LEFT JOIN (SELECT upper(tx) tx FROM sw) s ON s.tx = q.tx")),
    "classify_side": (classify_side, sql(BOOK, "SELECT offer_id, side FROM bk WHERE u % 7 = 1 AND u % 3 = 1")),
    "join_required": (join_required, "SELECT o_orderkey AS key, n, n IS NOT NULL matched FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"),
    "target_composition": (target_composition, sql(TARGETS + SEQUENCE_TAIL, f"SELECT {COMPOSITION} FROM tg JOIN seq ON tg.tx = seq.tx_hash WHERE incl")),
    "check_keys": (check_keys, "SELECT 'missing_right' problem, count(*) n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'repeated_left', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_right', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)"),
    "attach_metadata": (attach_metadata, sql(META, "SELECT tx tx_hash, li ledger_index, li metadata_ledger_index, CASE WHEN pay THEN 'Payment' WHEN offer THEN 'OfferCreate' ELSE 'AccountSet' END kind FROM m WHERE ti < 4")),
    "keep_targets": (keep_targets, sql(META, "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT k FROM o WHERE c % 10 = 0)")),
    "pending": (pending, "SELECT supp, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) items FROM (SELECT l_partkey % 997 part, l_suppkey supp FROM lineitem EXCEPT SELECT l_partkey % 997, l_suppkey FROM lineitem WHERE l_quantity > 30) GROUP BY 1"),
    "attach_book_side": (attach_book_side, sql(INTENTS, ", b AS (SELECT 'A' || (k - 1) tx, CASE WHEN k % 2 = 0 THEN 'gets_native' ELSE 'gets_issued' END side, 'B' || k offer_id FROM o) SELECT it.tx tx_hash, b.side, offer_id FROM it JOIN b ON b.tx = it.tx AND b.side = CASE WHEN ocur = 'XRP' THEN 'gets_native' ELSE 'gets_issued' END")),
    "pair_parameters": (pair_parameters, f"SELECT c_custkey, n_name, {n('n_regionkey')} n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "attach_fee": (attach_fee, sql(INTENTS, "SELECT tx tx_hash, CASE WHEN tx LIKE '%7' THEN 'not_one_fee' WHEN NOT (CASE WHEN k % 3 = 0 THEN 'XRP' ELSE cur END = icur AND CASE WHEN k % 3 = 0 THEN cur ELSE 'XRP' END = ocur) THEN 'direction_mismatch' ELSE 'ok' END problem FROM it")),
    "fill_lines": (fill_lines, sql(META, ", l AS (SELECT li, who, iss, cur, count(*) n, min(lpad(CAST(c AS VARCHAR), 12, '0')) b FROM m WHERE c % 3 = 0 GROUP BY ALL) SELECT t.li ledger_index, t.who owner_account, t.iss issuer, t.cur currency, coalesce(b, '0') balance, CASE WHEN n IS NULL THEN 'account_lines_missing_line_zero' ELSE 'account_lines' END source, CASE WHEN n > 1 THEN 'multiple_lines' ELSE 'ok' END problem "
        "FROM (SELECT DISTINCT li, who, iss, cur FROM m) t LEFT JOIN l ON l.li = t.li AND l.who = t.who AND l.iss = t.iss AND l.cur = t.cur")),
}
