"""Labels derived from one row: modes, roles, sides, shapes, buckets and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketflow.functions.constants import (
    GAIN_ALLOCATION,
    GAIN_ALLOCATION_OVER_LOSS,
    GAIN_BOTH,
    GAIN_COMPOUNDING,
    GAIN_COMPOUNDING_OVER_LOSS,
    GAIN_NONE,
    NATIVE,
)

DEC = "decimal(38,18)"


def truth(flag: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(flag, F.lit(False))


def bool_label(flag: Column) -> Column:
    return F.when(flag.isNull(), "null").when(flag, "true").otherwise("false")


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.cast("bigint"), F.lit(0).cast("bigint")).bitwiseAND(F.lit(bit).cast("bigint")) != 0


def intent_mode(tx_type: Column, is_sell: Column, partial: Column) -> Column:
    kind = F.upper(F.coalesce(tx_type, F.lit("")))
    return (
        F.when(kind == "OFFERCREATE", F.when(truth(is_sell), "offer_sell").otherwise("offer_buy"))
        .when(kind == "PAYMENT", F.when(truth(partial), "payment_partial").otherwise("payment_full"))
        .when(kind == "", "unknown")
        .otherwise(F.lower(kind))
    )


def intent_family(
    tx_type: Column, is_sell: Column, is_fok: Column, partial: Column, min_equals_max: Column, sized: Column
) -> Column:
    """Which side of the fill the intent fixes. ``sized`` says both limits are present."""
    kind = F.upper(F.coalesce(tx_type, F.lit("")))
    offer = (
        F.when(truth(is_sell) & truth(is_fok), "fixed_input")
        .when(truth(is_fok), "fixed_output")
        .otherwise("bounded_partial")
    )
    payment = F.when(truth(partial) & ~truth(min_equals_max), "bounded_partial").otherwise("fixed_output")
    return F.when(truth(sized) & (kind == "OFFERCREATE"), offer).when(
        truth(sized) & (kind == "PAYMENT"), payment
    )


def prediction_role(
    tx_type: Column, is_sell: Column, is_fok: Column, partial: Column, min_equals_max: Column
) -> Column:
    """``struct<prediction_role, predicted_side, constraint_side>`` from intent semantics alone."""

    def role(name: str, predicted: str | None, constraint: str | None) -> Column:
        return F.struct(
            F.lit(name).alias("prediction_role"),
            F.lit(predicted).cast("string").alias("predicted_side"),
            F.lit(constraint).cast("string").alias("constraint_side"),
        )

    kind = F.upper(F.coalesce(tx_type, F.lit("")))
    offer, payment = kind == "OFFERCREATE", kind == "PAYMENT"
    return (
        F.when(
            offer & truth(is_fok) & truth(is_sell),
            role("offer_fok_sell_input_target_output_predicted", "out", "in"),
        )
        .when(offer & truth(is_fok), role("offer_fok_buy_output_target_input_predicted", "in", "out"))
        .when(offer, role("offer_limit_order_crossing_both_computed", None, None))
        .when(payment & ~truth(partial), role("payment_full_output_target_input_predicted", "in", "out"))
        .when(
            payment & truth(min_equals_max),
            role("payment_partial_exact_output_target_input_predicted", "in", "out"),
        )
        .when(payment, role("payment_partial_dual_constraint_both_computed", None, None))
        .otherwise(role("unsupported_or_unknown_intent", None, None))
    )


def ttest_group(role: Column) -> Column:
    """Group a role belongs to in the endpoint tests; NULL for unsupported roles."""
    return (
        F.when(
            role.isin(
                "payment_full_output_target_input_predicted",
                "payment_partial_exact_output_target_input_predicted",
                "offer_fok_buy_output_target_input_predicted",
            ),
            "input_predicted",
        )
        .when(role == "offer_fok_sell_input_target_output_predicted", "output_predicted")
        .when(
            role.isin(
                "payment_partial_dual_constraint_both_computed",
                "offer_limit_order_crossing_both_computed",
            ),
            "both_computed",
        )
    )


def measurement_side(measurement: Column) -> Column:
    return F.when(measurement.endswith("same_input"), "same_input").when(
        measurement.endswith("same_output"), "same_output"
    )


def number(value: Column) -> Column:
    """Missing or unreadable numbers count as zero."""
    return F.coalesce(value.try_cast(DEC), F.lit(0).cast(DEC))


def positive(value: Column) -> Column:
    return F.greatest(number(value), F.lit(0).cast(DEC))


def venue_name(fill: Column) -> Column:
    pool = (positive(fill["amm_input"]) > 0) | (positive(fill["amm_output"]) > 0)
    book = (positive(fill["clob_input"]) > 0) | (positive(fill["clob_output"]) > 0)
    return (
        F.when(pool & book, "AMM+CLOB")
        .when(pool, "AMM-only")
        .when(book, "CLOB-only")
        .otherwise("No filled venue")
    )


def path_shape(has_pool: Column, has_book: Column) -> Column:
    return (
        F.when(truth(has_pool) & truth(has_book), "AMM+CLOB")
        .when(truth(has_pool), "AMM_ONLY")
        .when(truth(has_book), "CLOB_ONLY")
        .otherwise("NO_FILL")
    )


def leg_count_bucket(count: Column) -> Column:
    return (
        F.when(F.coalesce(count, F.lit(0)) <= 0, "0")
        .when(count == 1, "1")
        .when(count <= 3, "2-3")
        .when(count <= 10, "4-10")
        .otherwise(">10")
    )


def bucketed(value: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    """First label whose upper bound holds; NULL is ``none``."""
    label = F.when(value.isNull(), "none")
    for bound, name in bounds:
        label = label.when(value <= bound, name)
    return label.otherwise(above)


def book_gap_bucket(bps: Column) -> Column:
    bounds = [(0.01, "le_0_01"), (0.1, "0_01_0_1"), (1.0, "0_1_1"), (10.0, "1_10")]
    return bucketed(bps, bounds, "gt_10")


def pool_move_bucket(bps: Column) -> Column:
    bounds = [(0.001, "le_0_001"), (0.01, "0_001_0_01"), (0.1, "0_01_0_1")]
    return bucketed(bps, bounds, "gt_0_1")


def size_bucket(size: Column, p50: Column, p90: Column, p95: Column) -> Column:
    zero = F.lit(0)
    return (
        F.when(size <= 0, "unknown_size")
        .when(size >= F.coalesce(p95, zero), "very_large_p95_100")
        .when(size >= F.coalesce(p90, zero), "large_p90_95")
        .when(size >= F.coalesce(p50, zero), "medium_p50_90")
        .otherwise("small_p0_50")
    )


def bps_bucket(bps: Column) -> Column:
    return (
        F.when(bps <= 0, "no_improvement")
        .when(bps >= 10, "high_gt_10bps")
        .when(bps >= 1, "material_1_10bps")
        .when(bps >= F.lit("0.01").cast(DEC), "low_0_01_1bps")
        .otherwise("dust_lt_0_01bps")
    )


def scale_bucket(text: Column) -> Column:
    """Whether a decimal text shows at most six decimal places."""
    fraction = F.regexp_extract(text, r"^[+-]?\d*\.?(\d*)(?:[eE]([+-]?\d+))?$", 1)
    shown = F.regexp_extract(text, r"^[+-]?\d*\.?(\d*)(?:[eE]([+-]?\d+))?$", 2)
    # A failing cast costs far more than the test that avoids it.
    power = F.when(shown == "", F.lit(0)).otherwise(F.coalesce(shown.try_cast("int"), F.lit(0)))
    readable = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(text.isNull() | ~readable, "scale_unknown")
        .when(power - F.length(fraction) >= -6, "scale_le_6dp")
        .otherwise("scale_gt_6dp")
    )


def evidence_status(fit_status: Column) -> Column:
    return (
        F.when(fit_status == "strict_exact_match", "valid_strict_baseline")
        .when(fit_status == "structure_match_endpoint_residual", "review_structure_matched_baseline")
        .when(fit_status == "structure_mismatch", "suspect_structure_mismatch_baseline")
        .otherwise("unknown_missing_baseline_fit")
    )


def fit_status(strict: Column, structure: Column) -> Column:
    return (
        F.when(truth(strict), "strict_exact_match")
        .when(truth(structure), "structure_match_endpoint_residual")
        .otherwise("structure_mismatch")
    )


def improvement_type(found: Column, compounding: Column, allocation: Column, total: Column) -> Column:
    c, a, t = number(compounding), number(allocation), number(total)
    return (
        F.when(~truth(found) | (t <= 0), GAIN_NONE)
        .when((c > 0) & (a > 0), GAIN_BOTH)
        .when((c > 0) & (a < 0), GAIN_COMPOUNDING_OVER_LOSS)
        .when((a > 0) & (c < 0), GAIN_ALLOCATION_OVER_LOSS)
        .when(c > 0, GAIN_COMPOUNDING)
        .otherwise(GAIN_ALLOCATION)
    )


def delta_status(delta: Column) -> Column:
    return (
        F.when(delta.isNull(), "infeasible")
        .when(delta > 0, "improved")
        .when(delta < 0, "worse")
        .otherwise("unchanged")
    )


def amount_kind(raw: Column) -> Column:
    """Kind of a raw amount field: native, issued or absent."""
    return (
        F.when(raw.isNull(), "unknown")
        .when(raw.startswith("{") & (F.get_json_object(raw, "$.currency") != NATIVE), "IOU")
        .otherwise(NATIVE)
    )
