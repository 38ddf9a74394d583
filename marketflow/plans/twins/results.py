"""Same-fill summaries on derived results."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.functions.constants import MEASUREMENTS
from marketflow.operators import samefill as SF
from marketflow.operators.percentiles import percentile_linear
from marketflow.plans import derive as D
from marketflow.plans.twins.common import META, ORDERS, n, plain, r, sql

WEIGHT = 3


def rows(spark, root):
    return D.landed(spark, root, "results", D.results)


def _labelled(spark, root):
    return SF.labelled(rows(spark, root))


def same_fill_scope(spark, root):
    return plain(SF.same_fill_scope(rows(spark, root)).groupBy("pair", "side").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fixed_size").cast("double")).alias("size")), WEIGHT)


def weighted(spark, root):
    scoped = SF.with_weights(SF.same_fill_scope(rows(spark, root)))
    return plain(SF.weighted_bps(scoped, ["pair", "side"]), WEIGHT)


def dust_thresholds(spark, root):
    return plain(SF.dust_thresholds(SF.same_fill_scope(rows(spark, root))), 5)


def _kept(spark, root):
    scoped = SF.same_fill_scope(rows(spark, root))
    return SF.dust_filter(scoped, SF.dust_thresholds(scoped))


def dust_filter(spark, root):
    return plain(_kept(spark, root).groupBy("pair", "side").agg(F.count(F.lit(1)).alias("n"), F.min("fixed_size").alias("smallest")), 5)


def materiality(spark, root):
    scoped = SF.same_fill_scope(rows(spark, root))
    return plain(SF.materiality(scoped, SF.dust_thresholds(scoped)), WEIGHT)


def transition(spark, root):
    return plain(SF.route_transition(_kept(spark, root)), WEIGHT)


def book_gap(spark, root):
    return plain(SF.book_gap(_kept(spark, root)), WEIGHT)


def pool_movement(spark, root):
    return plain(SF.pool_movement(_kept(spark, root)), WEIGHT)


def mechanism_counts(spark, root):
    return SF.mechanism_counts(_kept(spark, root), ["pair"])


def _rated(spark, root):
    return SF.rated(SF.same_fill_scope(D.results(spark, root)))


def _submitted(spark, root):
    scoped = D.landed(spark, root, "rated", _rated)
    kept = SF.dust_filter(scoped, SF.dust_thresholds(scoped)).withColumn("tx_hash", F.regexp_replace("tx_hash", "^R", "A"))
    return SF.submitted_transactions(kept, D.metadata_heads(spark, root))


def submitted_fields(spark, root):
    return plain(SF.submitted_fields(D.landed(spark, root, "submitted", _submitted)), WEIGHT)


def corrected_types(spark, root):
    out = SF.corrected_types(rows(spark, root))
    return out.groupBy("raw_improvement_type", "improvement_type").agg(F.count(F.lit(1)).alias("n"))


def _fills(spark, root):
    o = D.orders(spark, root)
    k, c = F.col("k"), F.col("c")
    return o.select(
        "k", F.when(k % 2 == 0, "same_input").otherwise("same_output").alias("side"), c.alias("baseline_in"), (c * 2).alias("baseline_out"),
        F.when(k % 10 != 9, c - (k % 7 - 3)).alias("best_in"), F.when(k % 10 != 8, c * 2 + (k % 5 - 2)).alias("best_out"), F.when(k % 4 != 3, c * 2 + (k % 3 - 1)).alias("one_shot_out"))


def gain_decomposition(spark, root):
    return plain(SF.gain_decomposition(_fills(spark, root)).select("k", "compounding_gain", "allocation_gain", "total_gain", "total_gain_bps", "improvement_type"))


def counterfactual(spark, root):
    return plain(SF.counterfactual(_fills(spark, root)).select("k", "status", "delta_input", "delta_output", "input_saved", "delta_bps"))


def constraint_check(spark, root):
    out = SF.constraint_check(rows(spark, root))
    return plain(out.groupBy("pair", "violation", "under_spent").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("fixed_delta").cast("double")).alias("delta")), WEIGHT)


def constraint_examples(spark, root):
    return plain(SF.constraint_examples(SF.constraint_check(rows(spark, root)), 5))


def size_buckets(spark, root):
    out = SF.size_buckets(rows(spark, root))
    return out.groupBy("pair", "measurement", "materiality").agg(F.count(F.lit(1)).alias("n"))


def evidence(spark, root):
    return _labelled(spark, root).groupBy("pair", "fit_status", "evidence_status").agg(F.count(F.lit(1)).alias("n"))


def label_counts(spark, root):
    return SF.label_counts(_labelled(spark, root), ["pair", "measurement"])


def label_maps(spark, root):
    """Label counts as maps, read back as their size and total."""
    maps = SF.label_maps(SF.label_counts(_labelled(spark, root), ["pair"]), ["pair"])
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return plain(maps.select("pair", "label", F.size("counts").alias("kinds"), total.alias("n")))


def same_fill_summary(spark, root):
    return plain(SF.same_fill_summary(_labelled(spark, root)))


def pair_summary(spark, root):
    return plain(SF.same_fill_summary(_labelled(spark, root), ["pair"]))


def same_fill_global(spark, root):
    return plain(SF.same_fill_global(_labelled(spark, root)))


def result_summary(spark, root):
    return plain(SF.result_summary(rows(spark, root), ["pair"]), WEIGHT)


def result_types(spark, root):
    return plain(SF.result_types(rows(spark, root)), WEIGHT)


def certified_statuses(spark, root):
    return SF.certified_statuses(rows(spark, root))


def uncertified_reasons(spark, root):
    return SF.uncertified_reasons(rows(spark, root))


def top_improvements(spark, root):
    return plain(SF.top_improvements(_labelled(spark, root), 30).select("pair", "tx_hash", "measurement", "bps"))


def top_large_improvements(spark, root):
    return plain(SF.top_improvements(_labelled(spark, root), 30, large_only=True).select("pair", "tx_hash", "measurement", "bps"))


def trimmed_prices(spark, root):
    """Line items above the five-percent price of their return flag, counted."""
    li = D.table(spark, root, "lineitem").select("l_returnflag", "l_extendedprice")
    limit = percentile_linear(li, ["l_returnflag"], "l_extendedprice", {"limit": 0.05}).drop("n_values")
    return plain(li.join(limit, "l_returnflag").filter("l_extendedprice > limit").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")))


NAMES = ", ".join(f"'{m}'" for m in MEASUREMENTS)
RS = (
    ORDERS + f", rs AS (SELECT k, u, c, 'P' || (u % 5) pair, 'R' || (k // 2) tx, CASE WHEN k % 37 = 0 THEN NULL ELSE list_extract([{NAMES}], CAST(k % 6 + 1 AS INT)) END lm, "
    "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 2 = 0 THEN 'same_input' ELSE 'same_output' END side, k % 3 <> 0 fnd, CAST(CASE WHEN k % 8 = 0 THEN c / 10000000.0 ELSE c / 1000.0 END AS DOUBLE) bin, CAST(c * 2 / 1000.0 AS DOUBLE) bout, "
    "CASE WHEN k % 5 = 0 THEN 0 ELSE (k % 97) / 1000.0 END gain, (k % 1009) / 100.0 bps, CASE WHEN k % 41 = 0 THEN 0 ELSE (k % 1009) / 100.0 END ibps, "
    "CASE WHEN k % 50 = 0 THEN 0.5 ELSE -(k % 7) / 1000.0 END din, CASE WHEN k % 2 = 0 THEN (k % 89) / 1000.0 WHEN k % 9 = 0 THEN 0.25 ELSE 0 END dout, (k % 83) / 1000.0 saved, "
    "k % 7 - 3 comp, k % 11 - 5 alloc, k % 7 + k % 11 - 8 tot, k % 10 < 7 strict, "
    "CASE WHEN k % 2 = 0 THEN 'allocation_changed' WHEN k % 5 = 0 THEN 'amm_multi_slice_fee_compounding' ELSE 'none' END rawt, "
    "CASE WHEN k % 7 = 6 THEN 'missing' WHEN k % 3 = 0 THEN 'not_certified' ELSE 'exact_discrete_best_price' END claim FROM o), "
    "rw AS (SELECT *, CASE WHEN side = 'same_input' THEN bin ELSE bout END size, CAST(CASE side WHEN 'same_input' THEN CASE WHEN dout > 0 THEN dout ELSE gain END WHEN 'same_output' THEN CASE WHEN saved > 0 THEN saved WHEN din <> 0 THEN abs(din) ELSE gain END END AS DOUBLE) num, "
    "CASE side WHEN 'same_input' THEN bout WHEN 'same_output' THEN bin END den, fnd AND bps > 0 imp FROM rs), "
    "sc AS (SELECT * FROM rw WHERE strict AND side IS NOT NULL AND size > 0), "
    "th AS (SELECT pair, side, quantile_cont(size, 0.05) lim FROM sc GROUP BY 1, 2), kp AS (SELECT sc.* FROM sc JOIN th ON th.pair = sc.pair AND th.side = sc.side WHERE size > lim)"
)
STATS = lambda: (
    f"count(*) checks, count(*) FILTER (imp) improved, {r('CAST(count(*) FILTER (imp) AS DOUBLE) / count(*)', 3)} improved_rate, {r('coalesce(sum(num) / nullif(sum(den), 0) * 10000, 0)', 3)} weighted_bps, {r('sum(num)', 3)} weighted_numerator, {r('sum(den)', 3)} weighted_denominator, "
    f"count(*) FILTER (bps > 0) positive_count, {r('max(greatest(bps, 0))', 3)} positive_max_bps, {r('coalesce(quantile_disc(CASE WHEN bps > 0 THEN bps END, 0.5), 0)', 3)} positive_median_bps, {r('coalesce(quantile_disc(CASE WHEN bps > 0 THEN bps END, 0.95), 0)', 3)} positive_p95_bps"
)
VENUE = lambda p, b: f"CASE WHEN {p} AND {b} THEN 'AMM+CLOB' WHEN {p} THEN 'AMM-only' WHEN {b} THEN 'CLOB-only' ELSE 'No filled venue' END"
COST = lambda i: f"CAST(1 + ({i}) / 100000.0 AS DOUBLE)"
PRICE = lambda i: f"CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE / {COST(i)} ELSE {COST(i)} END"
GAPS = (
    f"gp0 AS (SELECT *, {PRICE('k % 100')} cur, {PRICE('k % 50')} p1, {PRICE('(k + 30) % 100')} p2 FROM kp), "
    "gp AS (SELECT *, CASE WHEN p1 <> cur AND p2 <> cur THEN least(abs(p1 / cur - 1) * 10000, abs(p2 / cur - 1) * 10000) WHEN p1 <> cur THEN abs(p1 / cur - 1) * 10000 WHEN p2 <> cur THEN abs(p2 / cur - 1) * 10000 END gap FROM gp0)"
)
SLOPE = lambda m: f"CAST(1 + (k % {m}) / 100000.0 AS DOUBLE)"
SIDED = lambda v: f"CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE / {v} ELSE {v} END"
TYPE = lambda fnd, c, a, t: f"CASE WHEN NOT ({fnd}) OR {t} <= 0 THEN 'none' WHEN {c} > 0 AND {a} > 0 THEN 'allocation_and_amm_multi_slice_fee_compounding' WHEN {c} > 0 AND {a} < 0 THEN 'amm_multi_slice_fee_compounding_offsets_allocation_loss' WHEN {a} > 0 AND {c} < 0 THEN 'allocation_changed_offsets_amm_multi_slice_fee_compounding_loss' WHEN {c} > 0 THEN 'amm_multi_slice_fee_compounding' ELSE 'allocation_changed' END"
LB = (
    RS + ", lb0 AS (SELECT *, coalesce(lm, 'unknown') measurement, CASE side WHEN 'same_input' THEN bout WHEN 'same_output' THEN bin ELSE 0 END sz, CASE WHEN coalesce(side, '') <> 'same_input' AND k % 8 = 0 THEN 'scale_gt_6dp' ELSE 'scale_le_6dp' END scl, CASE WHEN fnd THEN ibps ELSE 0 END fb, "
    "CASE side WHEN 'same_input' THEN din WHEN 'same_output' THEN dout ELSE 0 END fd FROM rw), "
    "lt AS (SELECT pair, measurement, scl, quantile_disc(sz, 0.5) p50, quantile_disc(sz, 0.9) p90, quantile_disc(sz, 0.95) p95 FROM lb0 WHERE sz > 0 GROUP BY 1, 2, 3), "
    "lb AS (SELECT lb0.*, CASE WHEN sz <= 0 THEN 'unknown_size' WHEN sz >= coalesce(p95, 0) THEN 'very_large_p95_100' WHEN sz >= coalesce(p90, 0) THEN 'large_p90_95' WHEN sz >= coalesce(p50, 0) THEN 'medium_p50_90' ELSE 'small_p0_50' END szb, "
    "CASE WHEN fb <= 0 THEN 'no_improvement' WHEN fb >= 10 THEN 'high_gt_10bps' WHEN fb >= 1 THEN 'material_1_10bps' WHEN fb >= 0.01 THEN 'low_0_01_1bps' ELSE 'dust_lt_0_01bps' END bb, "
    "coalesce((side = 'same_input' AND fd > 0) OR (side = 'same_output' AND fd <> 0), false) viol, coalesce(side = 'same_input' AND fd < 0, false) und, "
    f"{TYPE('fnd', 'comp', 'alloc', 'tot')} ctype, CASE WHEN k % 10 < 7 THEN 'strict_exact_match' WHEN k % 10 = 7 THEN 'structure_match_endpoint_residual' WHEN k % 10 = 8 THEN 'structure_mismatch' ELSE 'missing' END fs "
    "FROM lb0 LEFT JOIN lt ON lt.pair = lb0.pair AND lt.measurement = lb0.measurement AND lt.scl = lb0.scl), "
    "lc AS (SELECT *, scl || ':' || szb || ':' || bb mat, CASE fs WHEN 'strict_exact_match' THEN 'valid_strict_baseline' WHEN 'structure_match_endpoint_residual' THEN 'review_structure_matched_baseline' WHEN 'structure_mismatch' THEN 'suspect_structure_mismatch_baseline' ELSE 'unknown_missing_baseline_fit' END ev FROM lb)"
)
LABEL_COLS = {
    "analysis_layer": "'layer1_same_fill'", "measurement": "measurement", "comparison_status": "CASE WHEN k % 89 = 0 THEN 'unchanged' ELSE 'improved' END", "objective": "CASE WHEN k % 2 = 0 THEN 'max_output' ELSE 'min_input' END",
    "source_intent_family": "CASE k % 4 WHEN 0 THEN 'fixed_input' WHEN 1 THEN 'fixed_output' WHEN 2 THEN 'bounded_partial' ELSE 'unknown' END", "improvement_type": "ctype", "claim": "claim", "materiality": "mat", "fit_status": "fs", "evidence_status": "ev",
}
LABELS = "ll AS (" + " UNION ALL ".join(f"SELECT pair, measurement, '{k}' AS label, {v} AS value FROM lc" for k, v in LABEL_COLS.items()) + ")"
SUMMARY = lambda by: (
    f"SELECT {by}, count(*) n, count(*) FILTER (fnd) improved, {r('CAST(count(*) FILTER (fnd) AS DOUBLE) / count(*) * 100', 2)} improved_pct, count(*) FILTER (viol) constraint_violations, count(*) FILTER (und) under_spent, {r('max(fb)')} all_max, {r('max(fb) FILTER (fnd)')} improved_max, "
    + ", ".join(f"{r(f'quantile_disc(fb, {p / 100})')} all_p{p}, {r(f'quantile_disc(CASE WHEN fnd THEN fb END, {p / 100})')} improved_p{p}" for p in (50, 95, 99)) + f" FROM lb GROUP BY {by}"
)
SUBMITTED = (
    "pt AS (SELECT pair, k // 2 k, bool_or(imp) imp, sum(num) num, sum(den) den, max(bps) mb FROM kp GROUP BY 1, 2), "
    "fl AS (SELECT k, CASE WHEN pay THEN 'Payment' ELSE 'OfferCreate' END tx_type, unnest(CASE WHEN pay THEN ['Payment total', CASE WHEN b10 THEN 'tfPartialPayment' ELSE 'Exact delivery' END, 'DeliverMax = ' || CASE WHEN nin THEN 'IOU' ELSE 'XRP' END, "
    "'SendMax = ' || CASE WHEN k % 3 = 0 THEN 'unknown' WHEN nin THEN 'XRP' ELSE 'IOU' END, CASE WHEN b10 AND k % 7 IN (0, 1) THEN 'DeliverMin present' ELSE 'No DeliverMin' END, CASE WHEN route <> 0 THEN 'Paths present' ELSE 'No Paths' END, "
    "CASE WHEN b40 THEN 'tfLimitQuality' ELSE 'No tfLimitQuality' END, CASE WHEN b20 THEN 'tfNoRippleDirect' ELSE 'No tfNoRippleDirect' END] ELSE ['OfferCreate total', CASE WHEN b10 THEN 'tfSell' ELSE 'No tfSell' END, CASE WHEN turn IN (2, 3) THEN 'tfFillOrKill' ELSE 'No tfFillOrKill' END, "
    "CASE WHEN turn IN (1, 3) THEN 'tfImmediateOrCancel' ELSE 'No tfImmediateOrCancel' END, 'No tfPassive', 'TakerGets = ' || CASE WHEN nin THEN 'XRP' ELSE 'IOU' END, CASE WHEN k % 6 = 0 THEN 'OfferSequence' ELSE 'No OfferSequence' END, CASE WHEN k % 9 = 0 THEN 'Expiration' ELSE 'No Expiration' END] END) field FROM m WHERE pay OR offer)"
)
FILLS = "fi AS (SELECT k, k % 2 = 0 si, c bi, c * 2 bo, CASE WHEN k % 10 <> 9 THEN c - (k % 7 - 3) END xi, CASE WHEN k % 10 <> 8 THEN c * 2 + (k % 5 - 2) END xo, CASE WHEN k % 4 <> 3 THEN c * 2 + (k % 3 - 1) END os FROM o)"
GD = "gd AS (SELECT k, CASE WHEN si THEN coalesce(os, bo) - bo ELSE 0 END cg, CASE WHEN si THEN coalesce(xo, bo) - coalesce(os, bo) ELSE bi - coalesce(xi, bi) END ag, CASE WHEN si THEN coalesce(xo, bo) - bo ELSE bi - coalesce(xi, bi) END tg, CASE WHEN si THEN bo ELSE bi END w FROM fi)"
CF = "cf AS (SELECT *, CASE WHEN si THEN xo IS NOT NULL ELSE xi IS NOT NULL END ok FROM fi), cg AS (SELECT *, CASE WHEN ok THEN coalesce(xo, 0) - bo END dout, CASE WHEN ok AND si THEN coalesce(xi, 0) - bi END din, CASE WHEN ok AND NOT si THEN bi - coalesce(xi, 0) END sv FROM cf), ch AS (SELECT *, CASE WHEN si THEN dout ELSE sv END g, CASE WHEN si THEN bo ELSE bi END w FROM cg)"

TWINS = {
    "same_fill_scope": (same_fill_scope, sql(RS, f"SELECT pair, side, count(*) n, {r('sum(size)', 3)} AS size FROM sc GROUP BY 1, 2")),
    "weighted_bps": (weighted, sql(RS, f"SELECT pair, side, {STATS()} FROM sc GROUP BY 1, 2")),
    "dust_thresholds": (dust_thresholds, sql(RS, f"SELECT pair, side, {r('lim', 5)} dust_size FROM th")),
    "dust_filter": (dust_filter, sql(RS, f"SELECT pair, side, count(*) n, {r('min(size)', 5)} smallest FROM kp GROUP BY 1, 2")),
    "materiality": (materiality, sql(RS, ", u3 AS (SELECT 'materiality_full' AS \"table\", side AS key, * FROM sc UNION ALL SELECT 'materiality_dust_filtered', side, * FROM kp UNION ALL SELECT 'pair_materiality', pair, * FROM sc) " + f"SELECT \"table\", key, {STATS()} FROM u3 GROUP BY 1, 2")),
    "transition": (transition, sql(RS, f"SELECT {VENUE('k % 4 IN (0, 1)', 'k % 4 IN (0, 2)')} || '->' || {VENUE('k % 3 IN (0, 1)', 'k % 3 IN (0, 2)')} transition, {STATS()} FROM kp GROUP BY 1")),
    "book_gap": (book_gap, sql(RS, f", {GAPS} SELECT CASE WHEN gap IS NULL THEN 'none' WHEN gap <= 0.01 THEN 'le_0_01' WHEN gap <= 0.1 THEN '0_01_0_1' WHEN gap <= 1 THEN '0_1_1' WHEN gap <= 10 THEN '1_10' ELSE 'gt_10' END gap_bucket, {STATS()} FROM gp GROUP BY 1")),
    "pool_movement": (pool_movement, sql(RS, f", mv AS (SELECT *, abs({SIDED(SLOPE(17))} / ({SIDED(SLOPE(13))}) - 1) * 10000 mv FROM kp) SELECT CASE WHEN mv <= 0.001::DOUBLE THEN 'le_0_001' WHEN mv <= 0.01::DOUBLE THEN '0_001_0_01' WHEN mv <= 0.1::DOUBLE THEN '0_01_0_1' ELSE 'gt_0_1' END move_bucket, {STATS()} FROM mv GROUP BY 1")),
    "mechanism_counts": (mechanism_counts, sql(RS, "SELECT pair, count(*) FILTER (alloc > 0) allocation_positive_checks, count(*) FILTER (comp > 0) amm_slice_positive_checks, count(*) FILTER (alloc > 0 AND comp > 0) both_positive_checks FROM kp GROUP BY 1")),
    "submitted_fields": (submitted_fields, sql(RS + META.removeprefix(ORDERS), f", {SUBMITTED} SELECT tx_type, field, count(*) transactions, count(*) FILTER (imp) improved_transactions, {r('CAST(count(*) FILTER (imp) AS DOUBLE) / count(*)', 3)} improved_rate, {r('coalesce(sum(num) / nullif(sum(den), 0) * 10000, 0)', 3)} weighted_bps, {r('max(mb) FILTER (imp)', 3)} positive_max_bps, "
        f"{r('quantile_disc(CASE WHEN imp THEN mb END, 0.5)', 3)} positive_median_bps, {r('quantile_disc(CASE WHEN imp THEN mb END, 0.95)', 3)} positive_p95_bps FROM pt JOIN fl ON fl.k = pt.k GROUP BY 1, 2")),
    "corrected_types": (corrected_types, sql(RS, f"SELECT rawt raw_improvement_type, {TYPE('fnd', 'comp', 'alloc', 'tot')} improvement_type, count(*) n FROM rs GROUP BY 1, 2")),
    "gain_decomposition": (gain_decomposition, sql(ORDERS, f", {FILLS}, {GD} SELECT k, {n('cg')} compounding_gain, {n('ag')} allocation_gain, {n('tg')} total_gain, {r('CAST(tg AS DOUBLE) / w * 10000')} total_gain_bps, {TYPE('tg > 0', 'cg', 'ag', 'tg')} improvement_type FROM gd")),
    "counterfactual": (counterfactual, sql(ORDERS, f", {FILLS}, {CF} SELECT k, CASE WHEN g IS NULL THEN 'infeasible' WHEN g > 0 THEN 'improved' WHEN g < 0 THEN 'worse' ELSE 'unchanged' END status, {n('din')} delta_input, {n('dout')} delta_output, {n('sv')} input_saved, {r('CAST(g AS DOUBLE) / w * 10000')} delta_bps FROM ch")),
    "constraint_check": (constraint_check, sql(LB, f"SELECT pair, viol violation, und under_spent, count(*) n, {r('sum(fd)', 3)} AS delta FROM lb GROUP BY 1, 2, 3").replace("sum(fd)", "sum(CAST(fd AS DOUBLE))")),
    "constraint_examples": (constraint_examples, sql(LB, f", q AS (SELECT pair, tx, lm, fd, row_number() OVER (PARTITION BY pair ORDER BY tx, lm) rk FROM lb WHERE viol) SELECT pair, tx tx_hash, lm layer1_measurement, {r('fd')} fixed_delta, rk AS rank FROM q WHERE rk <= 5")),
    "size_buckets": (size_buckets, sql(LB, "SELECT pair, measurement, mat materiality, count(*) n FROM lc GROUP BY 1, 2, 3")),
    "evidence_status": (evidence, sql(LB, "SELECT pair, fs fit_status, ev evidence_status, count(*) n FROM lc GROUP BY 1, 2, 3")),
    "label_counts": (label_counts, sql(LB, f", {LABELS} SELECT pair, measurement, label, value, count(*) n FROM ll GROUP BY 1, 2, 3, 4")),
    "label_maps": (label_maps, sql(LB, f", {LABELS} SELECT pair, label, count(DISTINCT value) kinds, count(*) n FROM ll GROUP BY 1, 2")),
    "same_fill_summary": (same_fill_summary, sql(LB, SUMMARY("pair, measurement"))),
    "pair_summary": (pair_summary, sql(LB, SUMMARY("pair"))),
    "same_fill_global": (same_fill_global, sql(LB, f"SELECT pair, measurement, {n('grouping(pair, measurement)')} AS level, count(*) n, count(*) FILTER (fnd) improved, count(*) FILTER (viol) constraint_violations, count(*) FILTER (und) under_spent, count(DISTINCT tx) unique_tx, count(DISTINCT CASE WHEN fnd THEN tx END) improved_tx FROM lb GROUP BY ROLLUP (pair, measurement)")),
    "result_summary": (result_summary, sql(RS, "SELECT pair, count(*) measurement_count, count(*) FILTER (fnd) improved_count, count(*) FILTER (NOT fnd) unchanged_count, count(DISTINCT tx) unique_tx_count, count(DISTINCT CASE WHEN fnd THEN tx END) improved_tx_count, "
        + ", ".join(f"{r(f'sum({v}) / 1000.0', 3)} {g}, count(*) FILTER ({v} > 0) {g}_positive, {r(f'max(greatest({v}, 0)) / 10.0', 3)} {g}_max_bps" for g, v in (("amm_multi_slice_fee_compounding_gain", "comp"), ("allocation_optimization_gain", "alloc"), ("total_gain", "tot")))
        + ", count(*) FILTER (rawt = 'amm_multi_slice_fee_compounding' AND k % 4 = 1) compounding_explained, count(*) FILTER (rawt = 'amm_multi_slice_fee_compounding' AND k % 4 <> 1) compounding_unexplained, count(*) FILTER (claim NOT IN ('missing', 'not_certified')) certified_count, "
        f"{n('coalesce(sum(CASE WHEN k % 7 <> 6 THEN k % 5 END), 0)')} certified_intervals, {n('coalesce(sum(CASE WHEN k % 7 <> 6 THEN k % 3 END), 0)')} uncertified_intervals, {r('max(CASE WHEN fnd THEN ibps ELSE 0 END)', 3)} max_improvement_bps FROM rs GROUP BY 1")),
    "result_types": (result_types, sql(RS, f"SELECT rawt improvement_type, count(*) n, {r('sum(CAST(CASE WHEN fnd THEN gain ELSE 0 END AS DOUBLE))', 3)} total_gain, {r('max(CASE WHEN fnd THEN ibps ELSE 0 END)', 3)} max_bps FROM rs GROUP BY 1")),
    "certified_statuses": (certified_statuses, sql(RS, "SELECT CASE WHEN claim IN ('missing', 'not_certified') THEN 'not_certified' WHEN k % 89 = 0 THEN 'unchanged' ELSE 'improved' END certified_status, count(*) n FROM rs GROUP BY 1")),
    "uncertified_reasons": (uncertified_reasons, sql(RS, ", q AS (SELECT k, unnest(CASE WHEN claim = 'missing' THEN ['missing_certificate'] WHEN k % 4 = 1 AND k % 6 = 3 THEN ['clob_domain_truncated', 's1', 'uncertified_interval'] WHEN k % 4 = 1 THEN ['clob_domain_truncated'] WHEN k % 6 = 3 THEN ['s1', 'uncertified_interval'] ELSE ['not_certified'] END) reason FROM rs WHERE claim IN ('missing', 'not_certified')) SELECT reason, count(*) n FROM q GROUP BY 1")),
    "top_improvements": (top_improvements, sql(LB, f"SELECT pair, tx tx_hash, measurement, {r('fb')} bps FROM lb WHERE fnd ORDER BY fb DESC, pair, tx, measurement LIMIT 30")),
    "top_large_improvements": (top_large_improvements, sql(LB, f"SELECT pair, tx tx_hash, measurement, {r('fb')} bps FROM lb WHERE fnd AND szb IN ('large_p90_95', 'very_large_p95_100') AND bb = 'high_gt_10bps' ORDER BY fb DESC, pair, tx, measurement LIMIT 30")),
    "trimmed_prices": (trimmed_prices, "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) lim FROM lineitem GROUP BY 1) SELECT l.l_returnflag, count(*) n FROM lineitem l JOIN q ON q.l_returnflag = l.l_returnflag WHERE l_extendedprice > lim GROUP BY 1"),
}
