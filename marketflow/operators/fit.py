"""Fit statistics over compared transactions.

A comparison row has (strict_exact_match, structure_match, in_side_exact_match, out_side_exact_match,
in_signed_err, out_signed_err, prediction_role, predicted_side, constraint_side, failed_side, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.functions import labels as L
from marketflow.functions import stats as S
from marketflow.operators.percentiles import percentile_ceil
from marketflow.operators.scan import row_rank, top_rows


def with_relative_errors(df: DataFrame) -> DataFrame:
    """Errors of model totals against real totals per side, and the larger defined one.

    Input columns: model_total_in, real_total_in, model_total_out, real_total_out.
    """
    out = df
    for side in ("in", "out"):
        model, real = F.col(f"model_total_{side}"), F.col(f"real_total_{side}")
        out = out.withColumns(
            {
                f"{side}_rel_err": S.relative_error(model, real),
                f"{side}_signed_rel_err": S.relative_error(model, real, signed=True),
            }
        )
    return out.withColumn("max_rel_err", F.greatest("in_rel_err", "out_rel_err"))


def error_histogram(df: DataFrame, by: list[str], error: str) -> DataFrame:
    """Counts per error bucket; empty buckets are absent and ``bucket_rank`` gives report order."""
    label = S.error_bucket(F.col(error))
    return (
        df.select(*by, label.alias("bucket")).groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket_rank", S.error_bucket_rank(F.col("bucket")))
    )


def cumulative_histogram(histogram: DataFrame, by: list[str]) -> DataFrame:
    """Report rows =0, <=1e-12, <=1e-9 and >1e-9 with their share of all counted rows."""
    zero, tight, loose = F.col("bucket_rank") == 0, F.col("bucket_rank") <= 4, F.col("bucket_rank") <= 5
    sums = histogram.groupBy(*by).agg(
        F.sum("n").alias("_all"),
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in (
            ("_z", zero), ("_t", tight), ("_l", loose), ("_g", F.col("bucket_rank") == 6))],
    )
    rows = F.array(*[
        F.struct(F.lit(i).alias("line"), F.lit(text).alias("label"), F.col(col).alias("n"))
        for i, (text, col) in enumerate((("=0", "_z"), ("<= 1e-12", "_t"), ("<= 1e-9", "_l"), ("> 1e-9", "_g")))
    ])
    return sums.select(*by, F.inline(rows), "_all").select(
        *by, "line", "label", "n", S.ratio(F.col("n"), F.col("_all")).alias("share")
    )


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean and sample deviation of the defined values; one value has deviation 0."""
    n = F.count(value)
    return df.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"),
        F.when(n > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("stddev"),
    )


def t_test(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One-sample two-tailed test of a zero mean by Student's t.

    The p-value function sees one row per group.
    """
    error = F.col("stddev") / F.sqrt(F.col("n").cast("double"))
    flat = (F.col("n") < 2) | (error == 0)
    t_stat = F.when(~flat, F.try_divide(F.col("mean"), error))
    stats = moments(df, by, value).withColumns({"df": F.col("n") - 1, "t_stat": t_stat})
    certain = F.when(F.col("mean") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p = F.when(F.col("n") < 1, F.lit(None)).when(F.col("t_stat").isNull(), certain).otherwise(S.two_tailed_p(F.col("t_stat"), F.col("df")))
    tested = stats.withColumn("p_value", p)
    return tested.withColumn("reject", F.col("p_value") < 0.05)


def endpoint_errors(compared: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of a structure-matched transaction's errors: one row per side and role.

    Sides are in, out and max, plus predicted and constraint where the intent defines them.
    """
    of = lambda side: F.when(side == "in", F.col("in_signed_err")).when(side == "out", F.col("out_signed_err"))
    entry = lambda name, err: F.struct(F.lit(name).alias("side"), err.alias("signed"), F.abs(err).alias("unsigned"))
    rows = F.array(
        entry("in", F.col("in_signed_err")),
        entry("out", F.col("out_signed_err")),
        entry("max", F.greatest(F.abs("in_signed_err"), F.abs("out_signed_err"))),
        entry("predicted", of(F.col("predicted_side"))),
        entry("constraint", of(F.col("constraint_side"))),
    )
    matched = compared.filter("structure_match").select(*keep, F.inline(rows))
    optional = F.col("side").isin("predicted", "constraint")
    return matched.filter(~optional | F.col("unsigned").isNotNull())


def fit_summary(compared: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of strict, structure, amount-only and structure-false transactions."""
    strict, structure = F.col("strict_exact_match"), F.col("structure_match")
    n = F.count(F.lit(1))
    parts = {
        "strict_exact_match": F.count_if(strict),
        "structure_match": F.count_if(structure),
        "amount_only": F.count_if(~strict & structure),
        "structure_false": F.count_if(~structure),
    }
    cols = [c for name, part in parts.items() for c in (part.alias(f"{name}_count"), S.ratio(part, n).alias(f"{name}_rate"))]
    return compared.groupBy(*by).agg(n.alias("sample_count"), *cols)


def fit_histograms(compared: DataFrame, by: list[str]) -> DataFrame:
    """Error buckets per side over structure-matched rows, and over amount-only rows."""
    rows = endpoint_errors(compared, [*by, "strict_exact_match"])
    scope = F.explode(F.when(F.col("strict_exact_match") | ~F.col("side").isin("in", "out", "max"), F.array(F.lit("structure_matched")))
                      .otherwise(F.array(F.lit("structure_matched"), F.lit("amount_only"))))
    return error_histogram(rows.withColumn("scope", scope), [*by, "scope", "side"], "unsigned")


def fit_moments(compared: DataFrame, by: list[str]) -> DataFrame:
    """Signed and unsigned moments per side over structure-matched rows."""
    rows = endpoint_errors(compared, by).filter("side <> 'max'")
    kinds = F.array(F.struct(F.lit("signed").alias("kind"), F.col("signed").alias("err")), F.struct(F.lit("unsigned").alias("kind"), F.col("unsigned").alias("err")))
    return moments(rows.select(*by, "side", F.inline(kinds)), [*by, "side", "kind"], "err")


def role_validation(compared: DataFrame, by: list[str]) -> DataFrame:
    """Per prediction role: counts and how often each side, and each role's side, is exact."""
    inside, outside = F.col("in_side_exact_match"), F.col("out_side_exact_match")
    side = lambda c: F.when(F.col(c) == "in", inside).when(F.col(c) == "out", outside)
    tally = lambda c, v: F.count_if(F.col(c) == v)
    role = F.coalesce("prediction_role", F.lit("unknown"))
    return compared.withColumn("prediction_role", role).groupBy(*by, "prediction_role").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("strict_exact_match").alias("strict_exact_match_count"),
        F.count_if("structure_match").alias("structure_match_count"),
        F.count_if(~F.col("structure_match")).alias("structure_false_count"),
        *[tally(f"{c}_side", v).alias(f"{c}_{v}_count") for c in ("predicted", "constraint") for v in ("in", "out")],
        F.count_if(inside).alias("in_side_exact_count"),
        F.count_if(outside).alias("out_side_exact_count"),
        F.count_if(side("predicted_side")).alias("predicted_side_exact_count"),
        F.count_if(side("constraint_side")).alias("constraint_side_exact_count"),
    )


def ttest_rows(compared: DataFrame, by: list[str]) -> DataFrame:
    """Errors of the sides each t-test group measures: (by, ttest_group, side, signed, unsigned)."""
    group = L.ttest_group(F.col("prediction_role"))
    sides = F.when(group == "input_predicted", F.array(F.lit("in"))).when(group == "output_predicted", F.array(F.lit("out"))).otherwise(
        F.array(F.lit("in"), F.lit("out")))
    rows = compared.filter("structure_match").withColumn("ttest_group", group).filter("ttest_group is not null")
    rows = rows.withColumn("side", F.explode(sides))
    err = F.when(F.col("side") == "in", F.col("in_signed_err")).otherwise(F.col("out_signed_err"))
    return rows.select(*by, "tx_hash", "ttest_group", "side", err.alias("signed"), F.abs(err).alias("unsigned"))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join aggregates of the same groups; a NULL in a group column is a group like any other."""
    other = right.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return left.join(other, same, how).drop(*[f"_g_{c}" for c in by])


def ttest_groups(compared: DataFrame, by: list[str]) -> DataFrame:
    """Moments per t-test group and side, with the group's transaction count."""
    rows = ttest_rows(compared, by)
    sizes = rows.groupBy(*by, "ttest_group").agg(F.count_distinct("tx_hash").alias("tx_count"))
    n = F.count("unsigned")
    dev = lambda c: F.when(n > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))
    stats = rows.groupBy(*by, "ttest_group", "side").agg(
        n.alias("n"), F.avg("signed").alias("signed_mean"), dev("signed").alias("signed_stddev"),
        F.avg("unsigned").alias("unsigned_mean"), dev("unsigned").alias("unsigned_stddev"),
    )
    return join_groups(stats, sizes, [*by, "ttest_group"])


def breakdown_labels() -> Column:
    """The (dimension, key) labels one compared transaction counts under."""
    kind = F.upper(F.coalesce("transaction_type", F.lit("")))
    direction = F.concat_ws("->", "in_currency", "out_currency")
    mode = F.col("intent_mode")
    flag = lambda c: L.bool_label(F.col(c))
    limited = F.concat(F.lit("source_limited="), flag("source_limited"))
    has_min, has_cancel = F.col("has_min"), F.col("cancel_sequence").isNotNull()
    label = lambda dim, *parts: F.struct(F.lit(dim).alias("dimension"), F.concat_ws("|", *parts).alias("key"))
    named = lambda name, value: F.concat(F.lit(f"{name}="), value)
    combo, shape, limits = "by_intent_field_combo", "by_execution_shape", "by_restriction_flags"
    common = F.array(
        label("by_intent_mode", kind, mode),
        label("by_direction_and_mode", direction, mode),
        label(combo, kind, direction, mode, limited),
        label(shape, named("model", F.col("model_shape")), named("real", F.col("real_shape"))),
        label(shape, named("structure_match", flag("structure_match"))),
        label(shape, named("model_legs", F.col("model_legs_bucket")), named("real_legs", F.col("real_legs_bucket"))),
        label(shape, named("first_failed", F.coalesce("first_failed_kind", F.lit("none")))),
        label(shape, named("failed_side", F.coalesce("failed_side", F.lit("none")))),
        label(limits, limited),
    )
    offer = F.array(
        *[label(limits, named(c, flag(c))) for c in ("is_sell", "is_ioc", "is_fok", "is_passive")],
        label(limits, named("has_cancel_sequence", L.bool_label(has_cancel))),
        label(combo, kind, direction, mode, named("ioc", flag("is_ioc")), named("fok", flag("is_fok")), named("passive", flag("is_passive")), limited),
    )
    payment = F.array(
        label(limits, named("partial_allowed", flag("partial_allowed"))),
        label(limits, named("no_ripple_direct", flag("no_direct"))),
        label(limits, named("paths_present", flag("paths_present"))),
        label(limits, named("paths_has_external_asset", flag("paths_external"))),
        label(limits, named("has_delivermin", L.bool_label(has_min))),
        label(limits, named("paths_count", F.coalesce("paths_count", F.lit(0)).cast("string"))),
        label(combo, kind, direction, mode, named("delivermin", L.bool_label(has_min)), named("paths", flag("paths_present")), limited),
    )
    none = F.array().cast("array<struct<dimension:string,key:string>>")
    return F.concat(common, F.when(kind == "OFFERCREATE", offer).when(kind == "PAYMENT", payment).otherwise(none))


def _primary(df: DataFrame) -> DataFrame:
    matched = F.col("structure_match")
    cost = F.when(matched, F.abs("in_signed_err"))
    proceeds = F.when(matched, F.abs("out_signed_err"))
    primary = F.when(F.col("predicted_side") == "in", cost).when(F.col("predicted_side") == "out", proceeds)
    return df.withColumns({"cost_err": cost, "proceeds_err": proceeds, "max_err": F.greatest(cost, proceeds), "primary_err": primary})


BREAKDOWN_NEEDS = ["strict_exact_match", "structure_match", "primary_err", "cost_err", "proceeds_err", "max_err"]


def intent_breakdown(compared: DataFrame) -> DataFrame:
    """Fit per (dimension, key): counts, rates, four bucket maps and primary-error percentiles in bps.

    A transaction counts under each of its labels. Only the needed columns are fanned out, and each
    statistic combines inside the map tasks before it is shuffled.
    """
    rows = _primary(compared).select(F.explode(breakdown_labels()).alias("l"), *BREAKDOWN_NEEDS).select("l.*", *BREAKDOWN_NEEDS)
    return grouped_breakdown(rows, ["dimension", "key"])


def grouped_breakdown(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = fit_summary(rows, by).drop("amount_only_count", "amount_only_rate").withColumnRenamed("sample_count", "n")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_err").alias("err")) for k in ("primary", "cost", "proceeds", "max")])
    buckets = error_histogram(rows.select(*by, F.inline(kinds)), [*by, "kind"], "err")
    # At most eight buckets per kind are gathered, in report order.
    entries = F.sort_array(F.collect_list(F.struct("bucket_rank", "bucket", "n")))
    maps = buckets.groupBy(*by, "kind").agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["bucket"], e["n"]))).alias("m")
    )
    wide = maps.groupBy(*by).agg(*[
        F.max_by(F.col("m"), F.col("kind") == k).alias(f"{k}_buckets") for k in ("primary", "cost", "proceeds", "max")
    ])
    bps = rows.withColumn("primary_bps", S.to_bps(F.col("primary_err")))
    ranks = percentile_ceil(bps, by, "primary_bps", {"primary_bps_p50": 0.50, "primary_bps_p95": 0.95, "primary_bps_p99": 0.99})
    top = bps.groupBy(*by).agg(F.max("primary_bps").alias("primary_bps_max"))
    return join_groups(join_groups(join_groups(counts, wide, by), top, by), ranks.drop("n_values"), by, "left")


def top_errors(df: DataFrame, by: list[str], error: str, k: int, tie: str = "tx_hash") -> DataFrame:
    """The ``k`` largest defined errors per group."""
    return top_rows(df.filter(F.col(error).isNotNull()), by, [f"-{error}", tie], k)


def first_failure(compared: DataFrame, by: list[str]) -> DataFrame:
    """First transaction in ledger order that is not exact."""
    row = F.struct(*[c for c in compared.columns if c not in by])
    failed = compared.filter(~F.col("strict_exact_match"))
    order = F.struct("ledger_index", "transaction_index", "tx_hash")
    return failed.groupBy(*by).agg(F.min_by(row, order).alias("r")).select(*by, "r.*")


def amount_only_range(errors: DataFrame, by: list[str], error: str, expected: DataFrame) -> DataFrame:
    """Min, midpoint median and max over the smallest ``expected`` errors, and whether all were there.

    ``expected`` has (by, expected_count).
    """
    kept = errors.filter(F.col(error).isNotNull()).withColumn(error, F.abs(F.col(error)))
    counts = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("available"))
    bounds = join_groups(expected, counts, by, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    bounds = bounds.withColumn("_k", F.least("available", "expected_count"))
    ranked = row_rank(kept.select(*by, error, "tx_hash"), by, [error, "tx_hash"], "_r", gate=kept)
    low, high = F.floor((F.col("_k") + 1) / 2), F.floor((F.col("_k") + 2) / 2)
    at = lambda r: F.max(F.when(F.col("_r") == r, F.col(error)))
    picked = join_groups(ranked, bounds, by).filter(F.col("_r") <= F.col("_k")).groupBy(*by).agg(
        F.min(error).alias("min_err"), ((at(low) + at(high)) / 2).alias("median_err"), F.max(error).alias("max_err")
    )
    return join_groups(bounds, picked, by, "left").select(
        *by, "expected_count", "available", (F.col("available") >= F.col("expected_count")).alias("complete"),
        "min_err", "median_err", "max_err",
    )


def fit_pairs(compared: DataFrame) -> DataFrame:
    """Fit table per pair with a grand total row, percentages to four places."""
    strict, structure = F.col("strict_exact_match"), F.col("structure_match")
    n, fitted = F.count(F.lit(1)), F.count_if(strict)
    return compared.rollup("pair").agg(
        F.when(F.grouping("pair") == 1, "TOTAL").otherwise(F.first("pair")).alias("label"),
        n.alias("transactions"), fitted.alias("fully_fitted"),
        F.round(S.ratio(fitted, n) * 100, 4).alias("fully_fitted_rate_pct"),
        F.count_if(~strict & structure).alias("amount_only"), F.count_if(~structure).alias("structure_error"),
    ).drop("pair")
