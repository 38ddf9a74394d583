"""Model-to-real comparison and fit statistics on derived legs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import fit as FT
from marketflow.operators import legs as LG
from marketflow.plans import derive as D
from marketflow.plans.twins.activity import CONSTRAINT, MODE, PREDICTED, ROLE
from marketflow.plans.twins.common import INTENTS, n, plain, r, sql, student_t_sql
from marketflow.plans.twins.ledger import REAL_BOOK, REAL_POOL, value
from marketflow.plans.twins.market import BUCKET, BUCKET_RANK


def real(spark, root):
    return D.landed(spark, root, "real_legs", D._real_legs)


def structure_match(spark, root):
    out = LG.structure_match(D.model_legs(spark, root), real(spark, root))
    return plain(out.select("tx_hash", "model_leg_count", "real_leg_count", "structure_match", "identity_match", "pairable", "model_pool", "real_book"))


def pair_legs(spark, root):
    out = LG.pair_legs(D.model_legs(spark, root), real(spark, root))
    faced = F.when(F.col("model_legs").isNull(), 0).otherwise(F.size("model_legs"))
    return plain(out.select("tx_hash", "source_id", "leg_rank", faced.alias("faced")))


def leg_totals(spark, root):
    return plain(LG.leg_totals(real(spark, root), "out", "in"))


def compare_legs(spark, root):
    c = D.compared(spark, root)
    return plain(c.select("tx_hash", "strict_exact_match", "structure_match", "in_side_exact_match", "out_side_exact_match", "total_in_match", "total_out_match", "total_in_diff", "total_out_diff",
                          "first_failed_kind", "first_failed_id", "failed_side", "fit_bucket"))


def endpoint_residual(spark, root):
    out = LG.endpoint_residual(D.compared(spark, root))
    return out.select("tx_hash", *[(F.round(F.col(c) * 1e9, 3) + F.lit(0.0)).alias(c) for c in ("in_signed_err", "out_signed_err", "out_unsigned_err", "max_side_err")])


def path_shapes(spark, root):
    return D.compared(spark, root).select("tx_hash", "model_shape", "real_shape", "model_legs_bucket", "real_legs_bucket")


def fit_summary(spark, root):
    return plain(FT.fit_summary(D.compared(spark, root), ["pair"]))


def fit_histograms(spark, root):
    return plain(FT.fit_histograms(D.compared(spark, root), ["pair"]))


def fit_moments(spark, root):
    out = FT.fit_moments(D.compared(spark, root), ["pair"])
    return out.select("pair", "side", "kind", "n", *[(F.round(F.col(c) * 1e9, 2) + F.lit(0.0)).alias(c) for c in ("mean", "stddev")])


def role_validation(spark, root):
    return FT.role_validation(D.compared(spark, root), ["pair"])


def ttest_groups(spark, root):
    out = FT.ttest_groups(D.compared(spark, root), ["pair"])
    return out.select("pair", "ttest_group", "side", "n", "tx_count", *[(F.round(F.col(c) * 1e9, 2) + F.lit(0.0)).alias(c) for c in ("signed_mean", "signed_stddev", "unsigned_mean")])


def group_t_tests(spark, root):
    """Tests per group and side with p-values."""
    out = FT.t_test(FT.ttest_rows(D.compared(spark, root), ["pair"]), ["pair", "ttest_group", "side"], "signed")
    return out.select(
        "pair", "ttest_group", "side", "n", "df", "reject", *[(F.round(F.col(c) * 1e9, 2) + F.lit(0.0)).alias(c) for c in ("mean", "stddev")],
        *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("t_stat", "p_value")],
    )


def breakdown(spark, root):
    out = FT.intent_breakdown(D.compared(spark, root))
    bps = ["primary_bps_p50", "primary_bps_p95", "primary_bps_p99", "primary_bps_max"]
    zero = F.lit(0).cast("bigint")
    return out.select("dimension", "key", "n", "strict_exact_match_count", "structure_match_count", "structure_false_count",
                      F.coalesce(F.col("primary_buckets").getItem("=0"), zero).alias("primary_exact"), F.coalesce(F.col("proceeds_buckets").getItem("> 1e-9"), zero).alias("proceeds_above"),
                      *[(F.round(F.col(c) * 1e6, 3) + F.lit(0.0)).alias(c) for c in bps])


def top_errors(spark, root):
    rows = D.compared(spark, root).withColumn("err", F.abs("out_signed_err"))
    return FT.top_errors(rows, ["pair"], "err", 4).select("pair", "tx_hash", F.col("rank").cast("bigint").alias("rank"))


def first_fail(spark, root):
    return plain(FT.first_failure(D.compared(spark, root), ["pair"]).select("pair", "tx_hash", "ledger_index", "transaction_index"))


def fit_pairs(spark, root):
    return plain(FT.fit_pairs(D.compared(spark, root)))


def outlier_txs(spark, root):
    """Transactions whose totals differ, with the book side to look at."""
    from marketflow.operators.select import select_outliers

    rows = D.compared(spark, root).withColumn("version", F.struct("ledger_index", "transaction_index"))
    return select_outliers(rows, 0.5).select("tx_hash", (F.round("magnitude", 4) + F.lit(0.0)).alias("magnitude"))


COMPARED = (
    INTENTS + f", {REAL_BOOK}, {REAL_POOL}, rl AS (SELECT * FROM rb UNION ALL SELECT * FROM rp), tot AS (SELECT tx, sum(ov) ro, sum(iv) ri, count(*) nr FROM rl GROUP BY 1), "
    "f0 AS (SELECT it.*, 'N' || (li % 4) pair, NOT same has, k % 3 <> 0 ob, k % 2 = 0 am, NOT same AND k % 3 <> 0 AND k % 13 = 0 noob, NOT same AND k % 2 = 0 AND k % 19 = 0 noam, NOT same AND k % 3 <> 0 AND k % 13 <> 0 AND k % 17 = 0 split, "
    f"NOT same AND k % 11 = 0 off, {ROLE} AS rolen, {PREDICTED} pside, {CONSTRAINT} cside, {MODE} imode, coalesce(ro, 0) ro, coalesce(ri, 0) ri, coalesce(nr, 0) nr FROM it LEFT JOIN tot ON tot.tx = it.tx), "
    "f1 AS (SELECT *, NOT noob AND NOT noam paired, (NOT noob AND NOT noam AND NOT split) struct_ok, NOT noob AND NOT noam AND NOT off strict, NOT noob AND NOT noam inok, NOT noob AND NOT noam AND NOT off outok, "
    "CASE WHEN off THEN CASE WHEN nin THEN 0.0001 ELSE 0.000001 END ELSE 0 END ofs, "
    "CASE WHEN noob THEN CASE WHEN nin THEN c / 1000.0 ELSE 10 * c / 1000000.0 END ELSE 0 END + CASE WHEN noam THEN CASE WHEN nin THEN (c // 2) / 10000.0 ELSE c / 1000000.0 END ELSE 0 END misso, "
    "CASE WHEN noob THEN CASE WHEN nin THEN 20 * c / 1000000.0 ELSE 2 * c / 1000.0 END ELSE 0 END + CASE WHEN noam THEN CASE WHEN nin THEN c / 1000000.0 ELSE (c // 2) / 10000.0 END ELSE 0 END missi, "
    "nr - CAST(noob AS INT) - CAST(noam AS INT) + CAST(split AS INT) nm FROM f0), "
    "fc AS (SELECT *, CASE WHEN paired THEN CASE WHEN ofs = 0 THEN CAST(0 AS DOUBLE) ELSE -ofs / ro END END oe, CASE WHEN paired THEN CAST(0 AS DOUBLE) END ie FROM f1)"
)
RATE = lambda cond: f"count(*) FILTER ({cond})"
SIDES = (
    "sd AS (SELECT pair, tx, strict, 'in' side, ie e FROM fc WHERE struct_ok UNION ALL SELECT pair, tx, strict, 'out', oe FROM fc WHERE struct_ok UNION ALL SELECT pair, tx, strict, 'max', greatest(abs(ie), abs(oe)) FROM fc WHERE struct_ok UNION ALL "
    "SELECT pair, tx, strict, 'predicted', CASE pside WHEN 'in' THEN ie WHEN 'out' THEN oe END FROM fc WHERE struct_ok AND pside IS NOT NULL UNION ALL SELECT pair, tx, strict, 'constraint', CASE cside WHEN 'in' THEN ie WHEN 'out' THEN oe END FROM fc WHERE struct_ok AND cside IS NOT NULL)"
)
GROUP = "CASE WHEN rolen IN ('payment_full_output_target_input_predicted', 'payment_partial_exact_output_target_input_predicted', 'offer_fok_buy_output_target_input_predicted') THEN 'input_predicted' WHEN rolen = 'offer_fok_sell_input_target_output_predicted' THEN 'output_predicted' ELSE 'both_computed' END"
TT = f"tt AS (SELECT pair, tx, {GROUP} g, 'in' side, ie e FROM fc WHERE struct_ok AND {GROUP} <> 'output_predicted' UNION ALL SELECT pair, tx, {GROUP}, 'out', oe FROM fc WHERE struct_ok AND {GROUP} <> 'input_predicted'), tz AS (SELECT pair, g, count(DISTINCT tx) txn FROM tt GROUP BY 1, 2)"
nano = lambda e, d=3: r(f"({e}) * 1e9", d)
SHAPE = lambda pool, book: f"CASE WHEN {pool} AND {book} THEN 'AMM+CLOB' WHEN {pool} THEN 'AMM_ONLY' WHEN {book} THEN 'CLOB_ONLY' ELSE 'NO_FILL' END"
LEGB = lambda c: f"CASE WHEN {c} <= 0 THEN '0' WHEN {c} = 1 THEN '1' WHEN {c} <= 3 THEN '2-3' ELSE '4-10' END"
BL = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
DIRN = "icur || '->' || ocur"
FUNDS = "(CASE WHEN icur = 'XRP' THEN (5000000 + c * 10 - 1000000 - (CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END) * 200000 - 12) / 1000000.0 ELSE (5000000 + c) / 10000.0 END < ival)"
LIM = f"'source_limited=' || {BL(FUNDS)}"
LABELS = [
    ("by_intent_mode", "tt || '|' || imode", "true"),
    ("by_direction_and_mode", f"{DIRN} || '|' || imode", "true"),
    ("by_intent_field_combo", f"tt || '|' || {DIRN} || '|' || imode || '|' || {LIM}", "true"),
    ("by_execution_shape", f"'model=' || {SHAPE('has AND am AND NOT noam', 'has')} || '|real=' || {SHAPE('has AND am', 'has')}", "true"),
    ("by_execution_shape", f"'structure_match=' || {BL('struct_ok')}", "true"),
    ("by_execution_shape", f"'model_legs=' || {LEGB('nm')} || '|real_legs=' || {LEGB('nr')}", "true"),
    ("by_execution_shape", "'first_failed=' || CASE WHEN paired AND off THEN 'CLOB' ELSE 'none' END", "true"),
    ("by_execution_shape", "'failed_side=' || CASE WHEN paired AND off THEN 'out' ELSE 'none' END", "true"),
    ("by_restriction_flags", LIM, "true"),
    *[("by_restriction_flags", f"'{name}=' || {BL(col)}", "offer") for name, col in (("is_sell", "sell"), ("is_ioc", "ioc"), ("is_fok", "fok"), ("is_passive", "false"), ("has_cancel_sequence", "cancel IS NOT NULL"))],
    ("by_intent_field_combo", f"tt || '|' || {DIRN} || '|' || imode || '|ioc=' || {BL('ioc')} || '|fok=' || {BL('fok')} || '|passive=false|' || {LIM}", "offer"),
    *[("by_restriction_flags", f"'{name}=' || {BL(col)}", "pay") for name, col in (("partial_allowed", "partial"), ("no_ripple_direct", "no_direct"), ("paths_present", "has_paths"), ("paths_has_external_asset", "ext"), ("has_delivermin", "has_min"))],
    ("by_restriction_flags", "'paths_count=' || n_paths", "pay"),
    ("by_intent_field_combo", f"tt || '|' || {DIRN} || '|' || imode || '|delivermin=' || {BL('has_min')} || '|paths=' || {BL('has_paths')} || '|' || {LIM}", "pay"),
]
FAN = "fan AS (" + " UNION ALL ".join(f"SELECT '{d}' dimension, {key} AS key, strict, struct_ok, CASE WHEN struct_ok THEN CASE pside WHEN 'in' THEN abs(ie) WHEN 'out' THEN abs(oe) END END pe, CASE WHEN struct_ok THEN abs(oe) END poe FROM fc WHERE {cond}" for d, key, cond in LABELS) + ")"
CEIL = lambda q: f"max(CASE WHEN pe IS NOT NULL AND rk = ceil((m - 1) * {q}) + 1 THEN pe END)"

TWINS = {
    "structure_match": (structure_match, sql(COMPARED, f"SELECT tx tx_hash, {n('nm')} model_leg_count, {n('nr')} real_leg_count, struct_ok structure_match, paired identity_match, true pairable, am AND NOT noam model_pool, true real_book FROM fc WHERE has")),
    "pair_legs": (pair_legs, sql(COMPARED, f", pl AS (SELECT rl.*, noob, noam, split FROM rl JOIN fc ON fc.tx = rl.tx) SELECT tx tx_hash, sid source_id, CAST(1 AS BIGINT) leg_rank, {n('CASE WHEN src = ' + chr(39) + 'AMM' + chr(39) + ' THEN 1 - CAST(noam AS INT) WHEN sid LIKE ' + chr(39) + 'OB%' + chr(39) + ' THEN CASE WHEN noob THEN 0 WHEN split THEN 2 ELSE 1 END ELSE 1 END')} faced FROM pl")),
    "leg_totals": (leg_totals, sql(COMPARED, f"SELECT tx tx_hash, {r('ro')} total_out, {r('ri')} total_in FROM tot")),
    "compare_legs": (compare_legs, sql(COMPARED, f"SELECT tx tx_hash, strict strict_exact_match, struct_ok structure_match, inok in_side_exact_match, outok out_side_exact_match, missi = 0 total_in_match, ofs - misso = 0 total_out_match, {r('-missi')} total_in_diff, {r('ofs - misso')} total_out_diff, "
        "CASE WHEN paired AND off THEN 'CLOB' END first_failed_kind, CASE WHEN paired AND off THEN 'OA' || k END first_failed_id, CASE WHEN paired AND off THEN 'out' END failed_side, "
        "CASE WHEN strict THEN 'strict_exact_match' WHEN struct_ok THEN 'strict_failed_but_structure_matched' ELSE 'structure_mismatch' END fit_bucket FROM fc")),
    "endpoint_residual": (endpoint_residual, sql(COMPARED, f"SELECT tx tx_hash, {nano('ie')} in_signed_err, {nano('oe')} out_signed_err, {nano('abs(oe)')} out_unsigned_err, {nano('greatest(abs(ie), abs(oe))')} max_side_err FROM fc")),
    "path_shapes": (path_shapes, sql(COMPARED, f"SELECT tx tx_hash, {SHAPE('has AND am AND NOT noam', 'has')} model_shape, {SHAPE('has AND am', 'has')} real_shape, {LEGB('nm')} model_legs_bucket, {LEGB('nr')} real_legs_bucket FROM fc")),
    "fit_summary": (fit_summary, sql(COMPARED, "SELECT pair, count(*) sample_count, " + ", ".join(f"{RATE(c)} {name}_count, {r(f'CAST({RATE(c)} AS DOUBLE) / count(*)')} {name}_rate" for name, c in (("strict_exact_match", "strict"), ("structure_match", "struct_ok"), ("amount_only", "NOT strict AND struct_ok"), ("structure_false", "NOT struct_ok"))) + " FROM fc GROUP BY 1")),
    "fit_histograms": (fit_histograms, sql(COMPARED, f", {SIDES}, sc AS (SELECT pair, 'structure_matched' AS scope, side, abs(e) e FROM sd UNION ALL SELECT pair, 'amount_only', side, abs(e) FROM sd WHERE NOT strict AND side IN ('in', 'out', 'max')), hb AS (SELECT pair, scope, side, {BUCKET} bucket, count(*) n FROM sc GROUP BY ALL) SELECT pair, scope, side, bucket, n, {n(BUCKET_RANK)} bucket_rank FROM hb")),
    "fit_moments": (fit_moments, sql(COMPARED, f", {SIDES}, k2 AS (SELECT pair, side, 'signed' AS kind, e FROM sd WHERE side <> 'max' UNION ALL SELECT pair, side, 'unsigned', abs(e) FROM sd WHERE side <> 'max') SELECT pair, side, kind, count(e) n, {nano('avg(e)', 2)} mean, {nano('CASE WHEN count(e) > 0 THEN coalesce(stddev_samp(e), 0) END', 2)} AS stddev FROM k2 GROUP BY 1, 2, 3")),
    "role_validation": (role_validation, sql(COMPARED, f"SELECT pair, rolen prediction_role, count(*) n, {RATE('strict')} strict_exact_match_count, {RATE('struct_ok')} structure_match_count, {RATE('NOT struct_ok')} structure_false_count, "
        + ", ".join(f"{RATE(f'{c[0]}side = ' + chr(39) + v + chr(39))} {c}_{v}_count" for c in ("predicted", "constraint") for v in ("in", "out"))
        + f", {RATE('inok')} in_side_exact_count, {RATE('outok')} out_side_exact_count, {RATE('CASE pside WHEN ' + chr(39) + 'in' + chr(39) + ' THEN inok WHEN ' + chr(39) + 'out' + chr(39) + ' THEN outok END')} predicted_side_exact_count, {RATE('CASE cside WHEN ' + chr(39) + 'in' + chr(39) + ' THEN inok WHEN ' + chr(39) + 'out' + chr(39) + ' THEN outok END')} constraint_side_exact_count FROM fc GROUP BY 1, 2")),
    "ttest_groups": (ttest_groups, sql(COMPARED, f", {TT} SELECT tt.pair, tt.g ttest_group, side, count(e) n, max(txn) tx_count, {nano('avg(e)', 2)} signed_mean, {nano('CASE WHEN count(e) > 0 THEN coalesce(stddev_samp(e), 0) END', 2)} signed_stddev, {nano('avg(abs(e))', 2)} unsigned_mean FROM tt JOIN tz ON tz.pair = tt.pair AND tz.g = tt.g GROUP BY 1, 2, 3")),
    "group_t_tests": (group_t_tests, sql(COMPARED, f", {TT}, gs AS (SELECT pair, g, side, count(e) n, avg(e) a, CASE WHEN count(e) > 0 THEN coalesce(stddev_samp(e), 0) END d FROM tt GROUP BY 1, 2, 3), {student_t_sql('gs', 'pair, g, side')} "
        f"SELECT pair, g ttest_group, side, n, v df, p < 0.05 reject, {nano('a', 2)} mean, {nano('d', 2)} AS stddev, {r('t', 5)} t_stat, {r('p', 5)} p_value FROM tq").replace("WITH ", "WITH RECURSIVE ", 1)),
    "breakdown": (breakdown, sql(COMPARED, f", {FAN}, fr AS (SELECT *, row_number() OVER (PARTITION BY dimension, key ORDER BY pe NULLS LAST) rk, count(pe) OVER (PARTITION BY dimension, key) m FROM fan) "
        f"SELECT dimension, key, count(*) n, {RATE('strict')} strict_exact_match_count, {RATE('struct_ok')} structure_match_count, {RATE('NOT struct_ok')} structure_false_count, {RATE('pe = 0')} primary_exact, {RATE('poe > CAST(1e-9 AS DOUBLE)')} proceeds_above, "
        + ", ".join(f"{r(f'{CEIL(q)} * 10000 * 1e6', 3)} primary_bps_{name}" for name, q in (("p50", "0.50"), ("p95", "0.95"), ("p99", "0.99"))) + f", {r('max(pe) * 10000 * 1e6', 3)} primary_bps_max FROM fr GROUP BY 1, 2")),
    "top_errors": (top_errors, sql(COMPARED, ", q AS (SELECT pair, tx, row_number() OVER (PARTITION BY pair ORDER BY abs(oe) DESC, tx) rk FROM fc WHERE oe IS NOT NULL) SELECT pair, tx tx_hash, rk AS rank FROM q WHERE rk <= 4")),
    "first_fail": (first_fail, sql(COMPARED, ", q AS (SELECT pair, tx, li, ti, row_number() OVER (PARTITION BY pair ORDER BY li, ti, tx) rk FROM fc WHERE NOT strict) SELECT pair, tx tx_hash, li ledger_index, ti transaction_index FROM q WHERE rk = 1")),
    "fit_pairs": (fit_pairs, sql(COMPARED, f"SELECT CASE WHEN grouping(pair) = 1 THEN 'TOTAL' ELSE pair END AS label, count(*) transactions, {RATE('strict')} fully_fitted, {r(f'CAST({RATE('strict')} AS DOUBLE) / count(*) * 100', 4)} fully_fitted_rate_pct, {RATE('NOT strict AND struct_ok')} amount_only, {RATE('NOT struct_ok')} structure_error FROM fc GROUP BY ROLLUP (pair)")),
    "outlier_txs": (outlier_txs, sql(COMPARED, f", q AS (SELECT tx, greatest(abs(missi), abs(ofs - misso)) mg FROM fc) SELECT tx tx_hash, {r('mg', 4)} magnitude FROM q WHERE mg > 0.5")),
}
