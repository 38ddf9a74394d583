"""Metadata-to-legs jobs and state before a transaction, on derived metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import book as B
from marketflow.operators import legs as LG
from marketflow.plans import derive as D
from marketflow.plans.twins.base import BOOK, book_rows
from marketflow.plans.twins.common import INTENTS, META, ORDERS, n, plain, r, sql


def value(leg: str):
    return F.col(f"`{leg}`.units").cast("double") * F.pow(F.lit(10.0), F.col(f"`{leg}`.exponent").cast("double"))


def offer_changes(spark, root):
    return plain(B.offer_changes(D.metadata_rows(spark, root)).select("tx_hash", "offer_id", "kind", "side_pre", "side_post", "action", "step", "gets_changed"))


def offer_changes_of_asset(spark, root):
    return plain(B.offer_changes(D.metadata_rows(spark, root), ("T1", "I1")).select("tx_hash", "offer_id", "action"))


def deleted_without_fill(spark, root):
    return B.deleted_without_fill(D.metadata_rows(spark, root))


def _legs_out(legs):
    return plain(legs.select("tx_hash", "src", "source_id", value("out").alias("out_value"), value("in").alias("in_value"),
                             F.col("out.state_source").alias("out_source"), F.col("`in`.state_source").alias("in_source"), F.col("`in`.state_change").alias("in_change")))


def real_offer_legs(spark, root):
    return _legs_out(LG.real_offer_legs(D.records(spark, root)))


def real_pool_legs(spark, root):
    return _legs_out(LG.real_pool_legs(D.records(spark, root)))


def pool_pre_state(spark, root):
    swaps = D.orders(spark, root).select(D.tagged("A", F.col("k")).alias("tx_hash"), F.when(F.col("k") % 3 == 0, "none").otherwise(D.tagged("PL", F.col("u") % 7)).alias("amm_account"), D.tagged("T", F.col("u") % 7).alias("token_currency"), F.when(F.col("k") % 4 != 0, D.tagged("I", F.col("u") % 3)).alias("token_issuer"))
    return plain(LG.pool_pre_state(D.metadata(spark, root), swaps).select("tx_hash", "pool_account", "native_reserve", "token_reserve"))


def source_funds(spark, root):
    return plain(LG.source_funds(D.records(spark, root)).select("tx_hash", "source_funds", "source_limited"))


def tx_pre_funds(spark, root):
    return plain(B.tx_pre_funds(D.metadata(spark, root)).select("tx_hash", "offer_id", "funds"))


def funds_changes(spark, root):
    return plain(B.funds_changes(D.metadata_rows(spark, root)).select("tx_hash", "step", "account", "currency", "issuer", "funds"))


def funds_before(spark, root):
    """Native funds of each transaction's pool account before it."""
    o = D.orders(spark, root)
    pool = D.tagged("PL", F.col("u") % 7)
    asset = [F.lit("XRP").alias("currency"), F.lit("").alias("issuer")]
    requests = o.select(D.tagged("A", F.col("k")).alias("tx_hash"), D.div("k", 10).alias("ledger_index"), (F.col("k") % 10).alias("transaction_index"), pool.alias("account"), *asset)
    opening = o.filter("k % 2 = 0").select((D.div("k", 10) - 1).alias("ledger_index"), pool.alias("account"), *asset, F.col("c").cast("decimal(38,18)").alias("funds"))
    lines = o.filter("k % 7 = 0").select((D.div("k", 10) - 1).alias("ledger_index"), pool.alias("account"), *asset, (F.col("c") + 5).cast("decimal(38,18)").alias("funds"))
    changes = B.asked_changes(B.funds_changes(D.metadata_rows(spark, root)), requests)
    return plain(B.funds_before(requests, B.funds_seeds(opening, lines), changes).select("tx_hash", "account", "funds"))


def state_before(spark, root):
    """Per user and event type, the value in force before each error event."""
    ev = D.table(spark, root, "events").select("user_id", "event_type", F.col("event_id").alias("transaction_index"), F.lit(0).alias("step"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("state"))
    opening = D.table(spark, root, "events").select("user_id").distinct().select("user_id", F.lit("view").alias("event_type"), F.lit(-5.0).alias("state"))
    versions = B.version_intervals(opening, ev, ["user_id"], ["event_type"])
    targets = ev.filter("event_type = 'error'").select("user_id", "transaction_index")
    return plain(B.state_before(targets, versions, ["user_id"]).select("user_id", "transaction_index", "event_type", "state"))


def version_intervals(spark, root):
    """Line items as versions of a part inside a supplier; a second change at one place wins."""
    li = D.table(spark, root, "events").select("user_id", F.col("event_type").alias("entity"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 43200)).cast("bigint").alias("transaction_index"), F.col("event_id").cast("int").alias("step"), "value")
    none = li.limit(0).select("user_id", "entity", F.col("value").alias("state"))
    out = B.version_intervals(none, li.withColumnRenamed("value", "state"), ["user_id"], ["entity"])
    return plain(out)


def book_before(spark, root):
    """Order book before every intent, summed up per side."""
    meta = D.metadata(spark, root)
    targets = D.intents(spark, root).select("tx_hash", "ledger_index", "transaction_index")
    book = B.book_before(targets, book_rows(spark, root), B.offer_changes(meta))
    return book.groupBy("tx_hash", "side").agg(
        F.count(F.lit(1)).alias("offers"), F.count_if("own_pre_image").alias("own"), F.sum("sequence").alias("sequences"),
        F.count("owner_funds").alias("funded"), F.count("taker_gets_funded").alias("capped"))


SIDE_OUT = "CASE WHEN nin THEN 'gets_issued' ELSE 'gets_native' END"
SIDE_IN = "CASE WHEN nin THEN 'gets_native' ELSE 'gets_issued' END"
CHANGES = (
    f"ch AS (SELECT tx, li, ti, k, u, 'OA' || k offer_id, 'modified' kind, {SIDE_OUT} sp, {SIDE_OUT} sq, 0 step, true gc FROM m UNION ALL "
    f"SELECT tx, li, ti, k, u, 'OB' || k, 'deleted', {SIDE_OUT}, NULL, 1, k % 3 <> 0 FROM m UNION ALL SELECT tx, li, ti, k, u, 'OC' || k, 'created', NULL, {SIDE_IN}, 2, false FROM m)"
)
NATIVE_LEFT = "greatest({b} - 1000000 - {o} * 200000, 0)"
POOL_POST = "(1000000000 + c * 100 + CASE WHEN nin THEN c ELSE -c END)"
REAL_BOOK = (
    "rb AS (SELECT tx, k, c, nin, 'CLOB' src, 'OA' || k sid, CASE WHEN nin THEN 7 * c / 10000.0 ELSE 6 * c / 1000000.0 END ov, CASE WHEN nin THEN 12 * c / 1000000.0 ELSE 13 * c / 10000.0 END iv, "
    "CASE WHEN nin THEN 'account_delta' ELSE 'offer_node' END os, CASE WHEN nin THEN 'offer_node' ELSE 'account_delta' END isrc, CASE WHEN nin THEN 'decrease' ELSE 'increase' END ic FROM it WHERE NOT same UNION ALL "
    "SELECT tx, k, c, nin, 'CLOB', 'OB' || k, CASE WHEN nin THEN c / 1000.0 ELSE 10 * c / 1000000.0 END, CASE WHEN nin THEN 20 * c / 1000000.0 ELSE 2 * c / 1000.0 END, 'offer_node', 'offer_node', 'decrease' FROM it WHERE NOT same AND k % 3 <> 0)"
)
REAL_POOL = (
    "rp AS (SELECT tx, k, c, nin, 'AMM' src, pool sid, CASE WHEN nin THEN (c // 2) / 10000.0 ELSE c / 1000000.0 END ov, CASE WHEN nin THEN c / 1000000.0 ELSE (c // 2) / 10000.0 END iv, "
    "CASE WHEN nin THEN 'pool_line' ELSE 'pool_account' END os, CASE WHEN nin THEN 'pool_account' ELSE 'pool_line' END isrc, 'increase' ic FROM it WHERE NOT same AND k % 2 = 0)"
)
LEG_COLS = f"tx tx_hash, src, sid source_id, {r('ov')} out_value, {r('iv')} in_value, os out_source, isrc in_source, ic in_change"

TWINS = {
    "offer_changes": (offer_changes, sql(META, f", {CHANGES} SELECT tx tx_hash, offer_id, kind, sp side_pre, sq side_post, CASE WHEN sq IS NULL THEN 'delete' ELSE 'upsert' END AS action, {n('step')} step, gc gets_changed FROM ch")),
    "offer_changes_of_asset": (offer_changes_of_asset, sql(META, f", {CHANGES} SELECT tx tx_hash, offer_id, CASE WHEN sq IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM ch WHERE u % 7 = 1 AND u % 3 = 1")),
    "deleted_without_fill": (deleted_without_fill, sql(META, "SELECT tx tx_hash, 'OB' || k offer_id FROM m WHERE k % 3 = 0")),
    "real_offer_legs": (real_offer_legs, sql(INTENTS, f", {REAL_BOOK} SELECT {LEG_COLS} FROM rb")),
    "real_pool_legs": (real_pool_legs, sql(INTENTS, f", {REAL_POOL} SELECT {LEG_COLS} FROM rp")),
    "pool_pre_state": (pool_pre_state, sql(META, f"SELECT tx tx_hash, pool pool_account, 1000000000 + c * 100 native_reserve, {r('(10000000000 + c) / 10000.0')} token_reserve FROM m WHERE k % 2 = 0 OR k % 3 <> 0")),
    "source_funds": (source_funds, sql(INTENTS, ", q AS (SELECT *, CASE WHEN icur = 'XRP' THEN (5000000 + c * 10 - 1000000 - (CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END) * 200000 - 12) / 1000000.0 ELSE (5000000 + c) / 10000.0 END f FROM it) "
        f"SELECT tx tx_hash, {r('f')} source_funds, f < ival source_limited FROM q")),
    "tx_pre_funds": (tx_pre_funds, sql(META, f"SELECT tx tx_hash, 'OA' || k offer_id, {r('(20000000 + 10 * c) / 10000.0')} funds FROM m WHERE nin")),
    "funds_changes": (funds_changes, sql(META, ", q AS (" + " UNION ALL ".join([
        f"SELECT tx, 3 step, pool a, 'XRP' cu, '' i, CAST({NATIVE_LEFT.format(b=POOL_POST, o=3)} AS DOUBLE) f FROM m",
        f"SELECT tx, 5, who, 'XRP', '', CAST({NATIVE_LEFT.format(b='5000000 + c * 10 - 12', o=2)} AS DOUBLE) FROM m",
        "SELECT tx, 4, pool, cur, iss, (10000000000 + c + CASE WHEN nin THEN -1 ELSE 1 END * (c // 2)) / 10000.0 FROM m", "SELECT tx, 4, iss, cur, pool, 0 FROM m",
        "SELECT tx, 6, who, cur, iss, (5000000 + c + 7) / 10000.0 FROM m", "SELECT tx, 6, iss, cur, who, 0 FROM m",
        "SELECT tx, 7, maker, cur, iss, (20000000 + c * 10 + CASE WHEN nin THEN -7 ELSE 13 END * c) / 10000.0 FROM m", "SELECT tx, 7, iss, cur, maker, 0 FROM m",
    ]) + f") SELECT tx tx_hash, {n('step')} step, a account, cu currency, i issuer, {r('f')} funds FROM q")),
    "funds_before": (funds_before, sql(META, f", ev AS (SELECT li, pool, ti AS pos, CAST({NATIVE_LEFT.format(b=POOL_POST, o=3)} AS DOUBLE) f FROM m UNION ALL SELECT li, pool, -1, min(x) FROM (SELECT li, pool, c x FROM m WHERE k % 2 = 0 UNION ALL SELECT li, pool, c + 5 FROM m WHERE k % 7 = 0) GROUP BY 1, 2) "
        f"SELECT m.tx tx_hash, m.pool account, {r('ev.f')} funds FROM m ASOF LEFT JOIN ev ON m.li = ev.li AND m.pool = ev.pool AND m.ti > ev.pos")),
    "state_before": (state_before, "WITH t AS (SELECT user_id, event_id ti FROM events WHERE event_type = 'error'), ty AS (SELECT DISTINCT event_type FROM events), q AS (SELECT t.*, ty.event_type FROM t, ty), "
        "ch AS (SELECT user_id, event_type, event_id pos, CASE WHEN event_id % 13 <> 0 THEN value END s FROM events UNION ALL SELECT DISTINCT user_id, 'view', -1, CAST(-5 AS DOUBLE) FROM events) "
        f"SELECT q.user_id, q.ti transaction_index, q.event_type, {r('ch.s')} AS state FROM q ASOF JOIN ch ON q.user_id = ch.user_id AND q.event_type = ch.event_type AND q.ti > ch.pos WHERE ch.s IS NOT NULL"),
    "version_intervals": (version_intervals, "WITH e AS (SELECT user_id, event_type entity, CAST(floor(epoch(ts)) AS BIGINT) // 43200 pos, event_id, value FROM events), w AS (SELECT *, lead(pos) OVER (PARTITION BY user_id, entity ORDER BY pos, event_id) nx FROM e) "
        f"SELECT user_id, entity, pos from_index, nx to_index, {r('value')} AS state FROM w WHERE nx IS NULL OR nx > pos"),
    "book_before": (book_before, sql(INTENTS + ", " + BOOK.removeprefix(ORDERS + ", "), f", {CHANGES}, rows AS ("
        "SELECT it.tx, bk.side, bk.k seq, 0 own, CASE WHEN bk.funds IS NOT NULL THEN 1 ELSE 0 END fu, CASE WHEN bk.k % 7 = 0 THEN 1 ELSE 0 END cp FROM it JOIN bk ON bk.li = it.li - 1 UNION ALL "
        "SELECT it.tx, ch.sq, ch.k, 0, 0, 0 FROM it JOIN ch ON ch.li = it.li AND ch.ti < it.ti AND ch.sq IS NOT NULL UNION ALL "
        "SELECT it.tx, ch.sp, ch.k, 1, 0, 0 FROM it JOIN ch ON ch.tx = it.tx AND ch.sp IS NOT NULL) "
        f"SELECT tx tx_hash, side, count(*) offers, {n('sum(own)')} own, {n('sum(seq)')} sequences, {n('sum(fu)')} funded, {n('sum(cp)')} capped FROM rows GROUP BY 1, 2")),
}
