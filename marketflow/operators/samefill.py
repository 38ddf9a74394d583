"""Same-fill result summaries: weighted improvement, materiality, routes, gaps, labels and tops.

Result rows follow ``sources.schemas.SAME_FILL`` plus ``pair``. Amounts are decimal texts; a missing
or unreadable one counts as zero. Sums and ratios are DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.functions import labels as L
from marketflow.functions import stats as S
from marketflow.functions.constants import (
    GAIN_COMPOUNDING,
    OFFER_FILL_OR_KILL,
    OFFER_IMMEDIATE_OR_CANCEL,
    OFFER_PASSIVE,
    OFFER_SELL,
    PAYMENT_LIMIT_QUALITY,
    PAYMENT_NO_DIRECT,
    PAYMENT_PARTIAL,
    UNCERTIFIED_CLAIMS,
)
from marketflow.operators.percentiles import nearest_rank, percentile_linear, ranked_values
from marketflow.operators.scan import top_rows

DEC = "decimal(38,18)"


def _zero() -> Column:
    return F.lit(0).cast(DEC)


def is_strict() -> Column:
    status = F.col("baseline_fit.status") == "strict_exact_match"
    return L.truth(F.col("baseline_fit.strict_exact_match")) | L.truth(status)


def same_fill_scope(results: DataFrame) -> DataFrame:
    """Strictly fitted rows with a known fixed side and a positive fixed size."""
    side = L.measurement_side(F.col("layer1_measurement"))
    size = F.when(side == "same_input", L.positive(F.col("baseline.input"))).otherwise(L.positive(F.col("baseline.output")))
    return results.withColumns({"side": side, "fixed_size": size}).filter(
        is_strict() & F.col("side").isNotNull() & (F.col("fixed_size") > 0)
    )


def with_weights(results: DataFrame) -> DataFrame:
    """Add the weighted improvement's numerator and denominator, the improvement in bps and a flag.

    The numerator falls back from the comparison's gain to the stored improvement when it is zero.
    """
    side = L.measurement_side(F.col("layer1_measurement"))
    stored = L.positive(F.col("best.improvement"))
    first = lambda *options: F.coalesce(*[F.nullif(o, _zero()) for o in options], _zero())
    gained = first(L.positive(F.col("counterfactual_comparison.delta_output")), stored)
    saved = first(
        L.positive(F.col("counterfactual_comparison.input_saved")),
        F.abs(L.number(F.col("counterfactual_comparison.delta_input"))),
        stored,
    )
    numerator = F.when(side == "same_input", gained).when(side == "same_output", saved).otherwise(_zero())
    denominator = (
        F.when(side == "same_input", L.positive(F.col("baseline.output")))
        .when(side == "same_output", L.positive(F.col("baseline.input")))
        .otherwise(_zero())
    )
    bps = F.when(F.col("best.improvement_bps").isNotNull(), L.number(F.col("best.improvement_bps"))).otherwise(
        L.number(F.col("counterfactual_comparison.delta_bps"))
    )
    return results.withColumns({"weight_num": numerator.cast("double"), "weight_den": denominator.cast("double"), "bps": bps}).withColumn(
        "improved", L.truth(F.col("found_improvement")) & (F.col("bps") > 0)
    )


def weighted_bps(df: DataFrame, by: list[str]) -> DataFrame:
    """Checks, improved checks, weighted improvement and the distribution of positive improvements."""
    n, good = F.count(F.lit(1)), F.count_if("improved")
    num, den = F.sum("weight_num"), F.sum("weight_den")
    base = df.groupBy(*by).agg(
        n.alias("checks"), good.alias("improved"), S.ratio(good, n).alias("improved_rate"),
        F.coalesce(F.try_divide(num, den) * 10_000, F.lit(0.0)).alias("weighted_bps"),
        num.alias("weighted_numerator"), den.alias("weighted_denominator"),
        F.count_if(F.col("bps") > 0).alias("positive_count"),
        F.max(F.greatest("bps", _zero())).alias("positive_max_bps"),
    )
    ranks = ranked_values(df.filter("bps > 0"), by, "bps", {"positive_median_bps": nearest_rank(50), "positive_p95_bps": nearest_rank(95)})
    joined = base.join(ranks.drop("n_values"), by, "left")
    return joined.withColumns({c: F.coalesce(c, _zero()) for c in ("positive_median_bps", "positive_p95_bps")})


def rated(scoped: DataFrame) -> DataFrame:
    """Rows in scope as keys, size and weights: a filter that joins them need not shuffle their nested fills."""
    return with_weights(scoped).select("pair", "side", "tx_hash", "fixed_size", "improved", "weight_num", "weight_den", "bps")


def dust_thresholds(scoped: DataFrame, quantile: float = 0.05) -> DataFrame:
    """Size threshold per (pair, side), interpolated."""
    return percentile_linear(scoped, ["pair", "side"], "fixed_size", {"dust_size": quantile}).drop("n_values")


def dust_filter(scoped: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows above their pair's threshold; a pair without one keeps all its rows."""
    joined = scoped.join(thresholds, ["pair", "side"], "left")
    return joined.filter(F.col("fixed_size") > F.coalesce("dust_size", F.lit(0.0))).drop("dust_size")


def materiality(scoped: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Weighted improvement of three tables in one pass: all rows by side, kept rows by side, by pair."""
    rated = with_weights(scoped.join(thresholds, ["pair", "side"], "left"))
    kept = F.col("fixed_size") > F.coalesce("dust_size", F.lit(0.0))
    label = lambda table, key: F.struct(F.lit(table).alias("table"), key.alias("key"))
    labels = F.array(
        label("materiality_full", F.col("side")),
        F.when(kept, label("materiality_dust_filtered", F.col("side"))),
        label("pair_materiality", F.col("pair")),
    )
    rows = rated.withColumn("_l", F.explode(F.filter(labels, lambda x: x.isNotNull())))
    narrow = rows.select("_l.table", "_l.key", "weight_num", "weight_den", "bps", "improved")
    return weighted_bps(narrow, ["table", "key"])


def route_transition(kept: DataFrame) -> DataFrame:
    """Weighted improvement per move from the baseline's venue set to the best fill's."""
    move = F.concat_ws("->", L.venue_name(F.col("baseline")), L.venue_name(F.col("best")))
    return weighted_bps(with_weights(kept).withColumn("transition", move), ["transition"])


def book_gap_bps(row: Column) -> Column:
    """Smallest price gap between the matched interval and its neighbours, in bps; NULL without one."""
    matched, at = row["matched_interval"], row["point_units"]
    by_input = row["side"] == "input"

    def price(interval: Column) -> Column:
        per_input = interval["clob_out_per_input"].try_cast("double")
        inverse = F.when(per_input > 0, 1.0 / per_input).otherwise(F.lit(0.0))
        direct = F.coalesce(interval["clob_unit_cost"].try_cast("double"), F.lit(0.0))
        return F.when(by_input, inverse).otherwise(direct)

    current = price(matched)
    yes = lambda c: F.coalesce(c, F.lit(False))

    def adjacent(i: Column) -> Column:
        touches = yes(i["interval_hi"] == matched["interval_lo"]) | yes(i["interval_lo"] == matched["interval_hi"])
        return touches | yes(i["interval_lo"] == at) | yes(i["interval_hi"] == at)

    near = F.filter(row["intervals_sample"], lambda i: adjacent(i) & (price(i) > 0) & (price(i) != current))
    gaps = F.transform(near, lambda i: F.abs(price(i) / current - 1.0) * 10_000)
    return F.when(current > 0, F.array_min(gaps))


def pool_move_bps(row: Column) -> Column:
    """Change of the pool's marginal price across the matched interval, in bps."""
    matched, by_input = row["matched_interval"], row["side"] == "input"

    def price(text: Column) -> Column:
        value = F.coalesce(text.try_cast("double"), F.lit(0.0))
        return F.when(by_input, F.when(value > 0, 1.0 / value).otherwise(F.lit(0.0))).otherwise(value)

    low, high = price(matched["amm_marginal_lo"]), price(matched["amm_marginal_hi"])
    return F.when((low > 0) & (high > 0), F.abs(high / low - 1.0) * 10_000)


def book_gap(kept: DataFrame) -> DataFrame:
    gap = L.book_gap_bucket(book_gap_bps(F.col("best_point_diagnostic")))
    return weighted_bps(with_weights(kept).withColumn("gap_bucket", gap), ["gap_bucket"])


def pool_movement(kept: DataFrame) -> DataFrame:
    move = L.pool_move_bucket(pool_move_bps(F.col("best_point_diagnostic")))
    return weighted_bps(with_weights(kept).withColumn("move_bucket", move), ["move_bucket"])


def mechanism_counts(kept: DataFrame, by: list[str] | None = None) -> DataFrame:
    share = L.positive(F.col("gain_decomposition.allocation_optimization_gain")) > 0
    slices = L.positive(F.col("gain_decomposition.amm_multi_slice_fee_compounding_gain")) > 0
    return kept.groupBy(*(by or [])).agg(
        F.count_if(share).alias("allocation_positive_checks"),
        F.count_if(slices).alias("amm_slice_positive_checks"),
        F.count_if(share & slices).alias("both_positive_checks"),
    )


def submitted_labels(result: Column) -> Column:
    """Field labels of a submitted transaction: eight per payment or offer, none for other types."""
    kind, flags = F.upper(result["TransactionType"]), F.coalesce(result["Flags"], F.lit(0))
    pick = lambda test, yes, no: F.when(L.truth(test), yes).otherwise(no)
    flag = lambda bit, name: pick(L.has_flag(flags, bit), name, f"No {name}")
    has = lambda field: pick(result[field].isNotNull(), field, f"No {field}")
    deliver = F.coalesce(result["DeliverMax"], result["Amount"])
    payment = F.array(
        F.lit("Payment total"),
        pick(L.has_flag(flags, PAYMENT_PARTIAL), "tfPartialPayment", "Exact delivery"),
        F.concat(F.lit("DeliverMax = "), L.amount_kind(deliver)),
        F.concat(F.lit("SendMax = "), L.amount_kind(result["SendMax"])),
        pick(result["DeliverMin"].isNotNull(), "DeliverMin present", "No DeliverMin"),
        pick(F.size(result["Paths"]) > 0, "Paths present", "No Paths"),
        flag(PAYMENT_LIMIT_QUALITY, "tfLimitQuality"),
        flag(PAYMENT_NO_DIRECT, "tfNoRippleDirect"),
    )
    offer = F.array(
        F.lit("OfferCreate total"),
        flag(OFFER_SELL, "tfSell"),
        flag(OFFER_FILL_OR_KILL, "tfFillOrKill"),
        flag(OFFER_IMMEDIATE_OR_CANCEL, "tfImmediateOrCancel"),
        flag(OFFER_PASSIVE, "tfPassive"),
        F.concat(F.lit("TakerGets = "), L.amount_kind(result["TakerGets"])),
        has("OfferSequence"),
        has("Expiration"),
    )
    return F.when(kind == "PAYMENT", payment).when(kind == "OFFERCREATE", offer)


def submitted_transactions(kept: DataFrame, meta: DataFrame) -> DataFrame:
    """Improvement and submitted-field labels, one row per (pair, transaction). Rows of :func:`rated` have their weights."""
    per_tx = (kept if "weight_num" in kept.columns else with_weights(kept)).groupBy("pair", "tx_hash").agg(
        F.bool_or("improved").alias("improved"), F.sum("weight_num").alias("weight_num"),
        F.sum("weight_den").alias("weight_den"), F.greatest(F.max("bps"), _zero()).alias("max_bps"),
    )
    kind = F.when(F.upper("result.TransactionType") == "PAYMENT", "Payment").otherwise("OfferCreate")
    fields = meta.select("tx_hash", kind.alias("tx_type"), submitted_labels(F.col("result")).alias("labels")).filter("labels is not null")
    return per_tx.join(fields, "tx_hash").select("tx_type", "labels", "improved", "weight_num", "weight_den", "max_bps")


def submitted_fields(transactions: DataFrame) -> DataFrame:
    """Weighted improvement per label of :func:`submitted_transactions`, which is read three times: once written, it is made once."""
    rows = transactions.select("tx_type", F.explode("labels").alias("field"), "improved", "weight_num", "weight_den", "max_bps")
    n, good = F.count(F.lit(1)), F.count_if("improved")
    base = rows.groupBy("tx_type", "field").agg(
        n.alias("transactions"), good.alias("improved_transactions"), S.ratio(good, n).alias("improved_rate"),
        F.coalesce(F.try_divide(F.sum("weight_num"), F.sum("weight_den")) * 10_000, F.lit(0.0)).alias("weighted_bps"),
        F.max(F.when(F.col("improved"), F.col("max_bps"))).alias("positive_max_bps"),
    )
    ranks = ranked_values(rows.filter("improved"), ["tx_type", "field"], "max_bps",
                          {"positive_median_bps": nearest_rank(50), "positive_p95_bps": nearest_rank(95)})
    return base.join(ranks.drop("n_values"), ["tx_type", "field"], "left")


def corrected_types(results: DataFrame) -> DataFrame:
    """Improvement type from the gain decomposition; the stored type is kept as ``raw_improvement_type``."""
    d = F.col("gain_decomposition")
    stored = F.coalesce("improvement_type", F.lit("unknown"))
    derived = L.improvement_type(
        F.col("found_improvement"), d["amm_multi_slice_fee_compounding_gain"], d["allocation_optimization_gain"], d["total_gain"]
    )
    return results.withColumn("raw_improvement_type", stored).withColumn("improvement_type", derived)


def gain_decomposition(fills: DataFrame) -> DataFrame:
    """Split of the gain over the baseline into slicing and allocation parts, with bps and type.

    ``fills`` has side (same_input | same_output), baseline_in, baseline_out, best_in, best_out and
    one_shot_out (output of the baseline allocation in a single pool slice), as numbers.
    """
    by_input = F.col("side") == "same_input"
    base, best = F.col("baseline_out"), F.coalesce("best_out", "baseline_out")
    one_shot = F.coalesce("one_shot_out", "baseline_out")
    saved = F.col("baseline_in") - F.coalesce("best_in", "baseline_in")
    total = F.when(by_input, best - base).otherwise(saved)
    slicing = F.when(by_input, one_shot - base).otherwise(F.lit(0))
    share = F.when(by_input, best - one_shot).otherwise(saved)
    whole = F.when(by_input, base).otherwise(F.col("baseline_in"))
    out = fills.withColumns({"compounding_gain": slicing, "allocation_gain": share, "total_gain": total, "_w": whole})
    bps = {f"{c}_bps": F.try_divide(F.col(c).cast("double"), F.col("_w").cast("double")) * 10_000 for c in ("compounding_gain", "allocation_gain", "total_gain")}
    kind = L.improvement_type(F.col("total_gain") > 0, F.col("compounding_gain"), F.col("allocation_gain"), F.col("total_gain"))
    return out.withColumns(bps).withColumn("improvement_type", kind).drop("_w")


def counterfactual(fills: DataFrame) -> DataFrame:
    """Status and differences of the best fill against the baseline; a missing best is infeasible."""
    by_input = F.col("side") == "same_input"
    feasible = F.when(by_input, F.col("best_out").isNotNull()).otherwise(F.col("best_in").isNotNull())
    best_in = F.coalesce(F.col("best_in"), F.lit(0))
    best_out = F.coalesce(F.col("best_out"), F.lit(0))
    delta_out = F.when(feasible, best_out - F.col("baseline_out"))
    delta_in = F.when(feasible & by_input, best_in - F.col("baseline_in"))
    saved = F.when(feasible & ~by_input, F.col("baseline_in") - best_in)
    gain = F.when(by_input, delta_out).otherwise(saved)
    whole = F.when(by_input, F.col("baseline_out")).otherwise(F.col("baseline_in"))
    return fills.withColumns(
        {
            "status": L.delta_status(gain), "delta_input": delta_in, "delta_output": delta_out, "input_saved": saved,
            "delta_bps": F.try_divide(gain.cast("double"), whole.cast("double")) * 10_000,
        }
    )


def constraint_check(results: DataFrame) -> DataFrame:
    """Add the fixed side's change and whether it breaks the rule.

    A same-input fill may spend less but not more; a same-output fill must deliver the same.
    """
    measurement = F.col("layer1_measurement")
    by_input, by_output = measurement.endswith("same_input"), measurement.endswith("same_output")
    cmp = F.col("counterfactual_comparison")
    delta = F.when(by_input, L.number(cmp["delta_input"])).when(by_output, L.number(cmp["delta_output"])).otherwise(_zero())
    out = results.withColumn("fixed_delta", delta)
    return out.withColumns(
        {
            "violation": (by_input & (F.col("fixed_delta") > 0)) | (by_output & (F.col("fixed_delta") != 0)),
            "under_spent": by_input & (F.col("fixed_delta") < 0),
        }
    )


def constraint_examples(checked: DataFrame, k: int = 20) -> DataFrame:
    """First violations per pair in hash order."""
    bad = checked.filter("violation").select("pair", "tx_hash", "layer1_measurement", "fixed_delta")
    return top_rows(bad, ["pair"], ["tx_hash", "layer1_measurement"], k)


def size_buckets(results: DataFrame) -> DataFrame:
    """Add size, scale, bps and materiality labels.

    Size thresholds are nearest-rank percentiles within (pair, measurement, scale); they are one
    small row per such group and join back.
    """
    measurement = F.coalesce("layer1_measurement", F.lit("unknown"))
    by_input = measurement.endswith("same_input")
    size = (
        F.when(by_input, F.abs(L.number(F.col("baseline.output"))))
        .when(measurement.endswith("same_output"), F.abs(L.number(F.col("baseline.input"))))
        .otherwise(_zero())
    )
    text = F.when(by_input, F.col("baseline.output")).otherwise(F.col("baseline.input"))
    found = L.truth(F.col("found_improvement"))
    rows = results.withColumns(
        {
            "measurement": measurement, "size": size, "scale": L.scale_bucket(text),
            "bps": F.when(found, L.number(F.col("best.improvement_bps"))).otherwise(_zero()),
        }
    )
    key = ["pair", "measurement", "scale"]
    limits = ranked_values(rows.filter("size > 0"), key, "size", {f"_p{p}": nearest_rank(p) for p in (50, 90, 95)})
    joined = rows.join(limits.drop("n_values"), key, "left")
    named = joined.withColumns(
        {
            "size_bucket": L.size_bucket(F.col("size"), F.col("_p50"), F.col("_p90"), F.col("_p95")),
            "bps_bucket": L.bps_bucket(F.col("bps")),
        }
    )
    return named.withColumn("materiality", F.concat_ws(":", "scale", "size_bucket", "bps_bucket")).drop("_p50", "_p90", "_p95")


def labelled(results: DataFrame) -> DataFrame:
    """Result rows with every label the summaries count."""
    rows = constraint_check(size_buckets(corrected_types(results)))
    status = F.coalesce("baseline_fit.status", F.lit("missing"))
    return rows.withColumns(
        {
            "fit_status": status,
            "evidence_status": L.evidence_status(status),
            "comparison_status": F.coalesce("counterfactual_comparison.status", F.lit("missing")),
            "claim": F.coalesce("best_price_certificate.claim", F.lit("missing")),
            "found": L.truth(F.col("found_improvement")),
        }
    )


LABELS = {
    "analysis_layer": "missing",
    "measurement": "unknown",
    "comparison_status": "missing",
    "objective": "unknown",
    "source_intent_family": "unknown",
    "improvement_type": "unknown",
    "claim": "missing",
    "materiality": "missing",
    "fit_status": "missing",
    "evidence_status": "missing",
}


def label_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the ten label columns in long form: (by, label, value, n), from one unpivot."""
    entries = F.array(*[F.struct(F.lit(n).alias("label"), F.coalesce(F.col(n), F.lit(d)).alias("value")) for n, d in LABELS.items()])
    return rows.select(*by, F.inline(entries)).groupBy(*by, "label", "value").agg(F.count(F.lit(1)).alias("n"))


def same_fill_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and improvement distributions per (pair, measurement) over :func:`labelled` rows."""
    by = by or ["pair", "measurement"]
    n, good = F.count(F.lit(1)), F.count_if("found")
    base = rows.groupBy(*by).agg(
        n.alias("n"), good.alias("improved"), F.round(S.ratio(good, n) * 100, 2).alias("improved_pct"),
        F.count_if("violation").alias("constraint_violations"), F.count_if("under_spent").alias("under_spent"),
        F.max("bps").alias("all_max"), F.max(F.when(F.col("found"), F.col("bps"))).alias("improved_max"),
    )
    ranks = lambda df, name: ranked_values(df, by, "bps", {f"{name}_p{p}": nearest_rank(p) for p in (50, 95, 99)}).drop("n_values")
    return base.join(ranks(rows, "all"), by, "left").join(ranks(rows.filter("found"), "improved"), by, "left")


def label_maps(counts: DataFrame, by: list[str]) -> DataFrame:
    """Label counts as one map per label. Label values are few, so the gathered entries are too."""
    entries = F.sort_array(F.collect_list(F.struct("value", "n")))
    return counts.groupBy(*by, "label").agg(F.map_from_entries(entries).alias("counts"))


def same_fill_global(rows: DataFrame) -> DataFrame:
    """Roll-up over pairs: one row per (pair, measurement), per pair and for everything.

    Rows combine per (pair, measurement, transaction) first. Inside a transaction, whose rows are few, one of them is marked to count
    at each level, so distinct transactions are plain sums and nothing but the roll-up itself multiplies rows.
    """
    n, good = F.count(F.lit(1)), F.count_if("found")
    each = rows.groupBy("pair", "measurement", "tx_hash").agg(
        n.alias("n"), good.alias("improved"), F.count_if("violation").alias("violations"), F.count_if("under_spent").alias("under")
    )
    known = F.col("tx_hash").isNotNull()  # a NULL hash is no transaction; its rows are one per pair and measurement
    better = F.col("improved") > 0
    order = [F.desc(better), F.asc_nulls_first("pair"), F.asc_nulls_first("measurement")]
    everywhere = F.row_number().over(Window.partitionBy("tx_hash").orderBy(*order)) == 1
    in_pair = F.row_number().over(Window.partitionBy("tx_hash", "pair").orderBy(F.desc(better), F.asc_nulls_first("measurement"))) == 1
    marked = each.withColumns({"_t0": known, "_t1": known & in_pair, "_t3": known & everywhere, "_better": better})
    # The marked row of a transaction is an improved one if it has any, so one mark serves both counts.
    level = F.grouping_id()
    at_level = lambda extra: F.when(level == 0, F.count_if(F.col("_t0") & extra)).when(
        level == 1, F.count_if(F.col("_t1") & extra)).otherwise(F.count_if(F.col("_t3") & extra))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return marked.rollup("pair", "measurement").agg(
        level.alias("level"), total("n").alias("n"), total("improved").alias("improved"),
        total("violations").alias("constraint_violations"), total("under").alias("under_spent"),
        at_level(F.lit(True)).alias("unique_tx"), at_level(F.col("_better")).alias("improved_tx"),
    )


GAINS = ("amm_multi_slice_fee_compounding_gain", "allocation_optimization_gain", "total_gain")


def result_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a result set: gains, positive counts, maxima, certificates, distinct transactions."""
    found = L.truth(F.col("found_improvement"))
    d, cert = F.col("gain_decomposition"), F.col("best_price_certificate")
    claim = F.coalesce(cert["claim"], F.lit("missing"))
    gain = lambda g: L.number(d[g])
    compounding = F.col("improvement_type") == GAIN_COMPOUNDING
    explained = compounding & L.truth(F.col("amm_one_shot_diagnostic.explained_by_amm_one_shot"))
    by = by or []
    counts = {
        "measurement_count": F.count(F.lit(1)), "improved_count": F.count_if(found),
        **{f"{g}_positive": F.count_if(gain(g) > 0) for g in GAINS},
        "compounding_explained": F.count_if(explained), "_compounding": F.count_if(compounding),
        "certified_count": F.count_if(~claim.isin(*UNCERTIFIED_CLAIMS)),
        "certified_intervals": F.sum(cert["certified_interval_count"]), "uncertified_intervals": F.sum(cert["uncertified_interval_count"]),
    }
    sums = {g: F.sum(gain(g).cast("double")) for g in GAINS}
    largest = {
        **{f"{g}_max_bps": F.max(F.greatest(L.number(d[f"{g}_bps"]), _zero())) for g in GAINS},
        "max_improvement_bps": F.max(F.when(found, L.number(F.col("best.improvement_bps"))).otherwise(_zero())),
    }
    # One row per transaction, then per group: distinct transactions are a count of rows.
    each = results.groupBy(*by, F.nullif("tx_hash", F.lit("")).alias("_tx")).agg(*[c.alias(name) for name, c in {**counts, **sums, **largest}.items()])
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    out = each.groupBy(*by).agg(
        *[total(name).alias(name) for name in counts], *[F.sum(name).alias(name) for name in sums], *[F.max(name).alias(name) for name in largest],
        F.count("_tx").alias("unique_tx_count"), F.count_if(F.col("_tx").isNotNull() & (F.col("improved_count") > 0)).alias("improved_tx_count"),
    )
    return out.select(
        *by, "measurement_count", "improved_count", (F.col("measurement_count") - F.col("improved_count")).alias("unchanged_count"),
        "unique_tx_count", "improved_tx_count", *GAINS, *[f"{g}_positive" for g in GAINS], *[f"{g}_max_bps" for g in GAINS],
        "compounding_explained", (F.col("_compounding") - F.col("compounding_explained")).alias("compounding_unexplained"),
        "certified_count", "certified_intervals", "uncertified_intervals", "max_improvement_bps",
    )


def result_types(results: DataFrame) -> DataFrame:
    """Count, total gain and largest improvement per improvement type."""
    found = L.truth(F.col("found_improvement"))
    best = F.col("best")
    return results.groupBy(F.coalesce("improvement_type", F.lit("unknown")).alias("improvement_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(found, L.number(best["improvement"])).otherwise(_zero()).cast("double")).alias("total_gain"),
        F.max(F.when(found, L.number(best["improvement_bps"])).otherwise(_zero())).alias("max_bps"),
    )


def certified_statuses(results: DataFrame) -> DataFrame:
    """Comparison status counts, with results lacking a certificate counted apart."""
    claim = F.coalesce("best_price_certificate.claim", F.lit("missing"))
    status = F.when(claim.isin(*UNCERTIFIED_CLAIMS), "not_certified").otherwise(
        F.coalesce("counterfactual_comparison.status", F.lit("missing"))
    )
    return results.groupBy(status.alias("certified_status")).agg(F.count(F.lit(1)).alias("n"))


def uncertified_reasons(results: DataFrame) -> DataFrame:
    """Why results lack a certificate; a result counts once under each distinct reason."""
    cert = F.col("best_price_certificate")
    claim = F.coalesce(cert["claim"], F.lit("missing"))
    cut = F.when(cert["domain_coverage_complete"] == F.lit(False), "clob_domain_truncated")
    none = F.array().cast("array<string>")
    statuses = F.transform(
        F.coalesce(cert["uncertified_intervals"], F.array().cast("array<struct<status:string>>")),
        lambda i: F.coalesce(i["status"], F.lit("uncertified_interval")),
    )
    listed = F.array_distinct(F.concat(F.when(cut.isNotNull(), F.array(cut)).otherwise(none), statuses))
    reasons = F.when(cert.isNull(), F.array(F.lit("missing_certificate"))).when(F.size(listed) > 0, listed).otherwise(
        F.array(F.coalesce(cert["claim"], F.lit("not_certified")))
    )
    rows = results.filter(claim.isin(*UNCERTIFIED_CLAIMS)).select(F.explode(reasons).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def top_improvements(rows: DataFrame, k: int, *, large_only: bool = False) -> DataFrame:
    """The ``k`` largest improvements, optionally among large fills with at least ten bps."""
    kept = rows.filter("found")
    if large_only:
        big = F.col("size_bucket").isin("large_p90_95", "very_large_p95_100") & (F.col("bps_bucket") == "high_gt_10bps")
        kept = kept.filter(big)
    return kept.orderBy(F.desc("bps"), "pair", "tx_hash", "measurement").limit(k)
