"""Exact amounts: canonical digits, ledger rounding, qualities and error labels."""

from decimal import ROUND_HALF_EVEN, Context, Decimal

import pytest
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.functions import labels as L
from marketflow.functions import stats as ST

CANONICAL = {
    "1.2": (1200000000000000, -15),
    "0": (0, -100),
    "-7.50": (-7500000000000000, -15),
    "12345678901234565": (1234567890123456, 1),
    "12345678901234575": (1234567890123458, 1),
    "99999999999999999": (1000000000000000, 2),
    "1e-5": (1000000000000000, -20),
    "1e-120": (0, -100),
    ".5": (5000000000000000, -16),
    "abc": None,
    "1e95": (1000000000000000, 80),
    "1e96": None,
}


def test_canonical(spark):
    df = spark.createDataFrame([(t,) for t in CANONICAL], "t string")
    got = {r["t"]: r["c"] and tuple(r["c"]) for r in df.select("t", A.canonical("t").alias("c")).collect()}
    assert {k: v and (int(v[0]), v[1]) for k, v in got.items()} == CANONICAL


def test_union_typed_amounts(spark):
    rows = [("15",), ('{"currency":"TOK","issuer":"I","value":"0.5"}',), ("x",), (None,)]
    got = [r["a"] for r in spark.createDataFrame(rows, "raw string").select(A.parse_amount("raw").alias("a")).collect()]
    assert (got[0]["currency"], int(got[0]["units"]), got[0]["exponent"], got[0]["value"]) == ("XRP", 15, -6, Decimal("0.000015").quantize(Decimal("1e-18")))
    assert (got[1]["currency"], got[1]["issuer"], int(got[1]["units"]), got[1]["inexact"]) == ("TOK", "I", 5 * 10**15, False)
    assert got[2] is None and got[3] is None


@pytest.mark.parametrize(
    "a,b",
    [("1234567890.123456", "0.00001234567890123456"), ("1", "-1"), ("9999999999999999", "1"), ("1e30", "1e-30"), ("0", "2.5"), ("3.3", "-3.2999999999999")],
)
def test_signed_sum_matches_decimal(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(A.canonical("a").alias("a"), A.canonical("b").alias("b"))
    got = df.select(A.signed_sum("a", "b", 1, "false").alias("s")).first()["s"]
    want = Context(prec=16, rounding=ROUND_HALF_EVEN).add(Decimal(a), Decimal(b))
    assert Decimal(int(got["units"])).scaleb(got["exponent"]) == want


def test_book_directory(spark):
    df = spark.createDataFrame([("0" * 48 + "4F06E16D1F80A22E",), ("short",)], "d string")
    rows = df.select(A.book_quality(F.col("d")).alias("q"), A.book_rate(F.col("d")).alias("r")).collect()
    assert int(rows[0]["q"]) == int("4F06E16D1F80A22E", 16)
    assert rows[0]["r"] == pytest.approx(0.000001936708656472622, rel=1e-14)
    assert rows[1]["q"] is None


def test_tick_rounding_goes_up(spark):
    df = spark.createDataFrame([(1234567890123456, 5), (1234500000000000, 5), (1234567890123456, 16), (1234567890123456, None)], "m bigint, t int")
    assert [int(r[0]) for r in df.select(A.round_to_tick("m", "t")).collect()] == [1234600000000000, 1234500000000000, 1234567890123456, 1234567890123456]


def test_currency_code(spark):
    df = spark.createDataFrame([("RLUSD",), ("",), ("x" * 21,), ("é",)], "l string")
    assert [r[0] for r in df.select(A.ascii_currency_hex(F.col("l"))).collect()] == ["524C555344" + "0" * 30, None, None, None]


def test_error_buckets(spark):
    values = [None, 0.0, 5e-16, 5e-15, 5e-14, 5e-13, 5e-10, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "e double")
    labels = [r[0] for r in df.select(ST.error_bucket(F.col("e"))).collect()]
    assert labels == ["undefined(real=0, model!=0)", "=0", "<= 1e-15", "<= 1e-14", "<= 1e-13", "<= 1e-12", "<= 1e-9", "> 1e-9"]


def test_scale_bucket(spark):
    df = spark.createDataFrame([("1.500",), ("0.1234567",), ("2e-7",), ("5",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(L.scale_bucket(F.col("t"))).collect()] == ["scale_le_6dp", "scale_gt_6dp", "scale_gt_6dp", "scale_le_6dp", "scale_unknown", "scale_unknown"]


def test_p_values(spark):
    df = spark.createDataFrame([(0.0,), (1.959963985,), (-1.959963985,), (float("inf"),), (None,)], "t double")
    got = [r[0] for r in df.select(ST.two_tailed_p(F.col("t"), F.lit(1e10))).collect()]  # so many degrees of freedom are normal
    assert got[0] == 1.0 and got[1] == pytest.approx(0.05, abs=1e-8) and got[2] == got[1] and got[3] == 0.0 and got[4] is None


def test_digits_behind_the_half_round_up(spark):
    from pyspark.sql import functions as F

    from marketflow.functions.amounts import canonical_sql

    text = "1000000000000000" + "5" + "0" * 21 + "1"
    exact = "1000000000000000" + "5" + "0" * 22
    rows = spark.createDataFrame([(text,), (exact,)], "t string").select(F.expr(canonical_sql("t")).alias("n")).collect()
    assert [int(r["n"]["units"]) for r in rows] == [1000000000000001, 1000000000000000]


def test_steps_give_what_nested_expressions_give(spark):
    texts = ["0", "-0", "1", "-12.5", "0.1", "123456789012345678", "1234567890123456.5", "1234567890123455.5", "9999999999999999.5", "1e20", "-7e-20", "1e-90", "1e99", "x", "", "1" * 45]
    raws = [*texts, *[f'{{"currency":"T","issuer":"i","value":"{t}"}}' for t in texts], '{"currency":"T"}', "{broken", None]
    df = spark.createDataFrame([(i, a, b) for i, a in enumerate(raws) for b in raws], "i int, a string, b string")
    nested = df.withColumns({"x": A.parse_amount("a"), "y": A.parse_amount("b")})
    steps = A.parsed(df, {"x": "a", "y": "b"})
    assert steps.columns == nested.columns and steps.schema["x"].dataType.simpleString() == nested.schema["x"].dataType.simpleString()
    assert "lambda" not in steps._jdf.queryExecution().optimizedPlan().toString()
    native = "x.currency = 'XRP' and y.currency = 'XRP'"
    nested = nested.withColumn("z", A.signed_sum("x", "y", -1, native))
    steps = A.summed(steps, {"z": ("x", "y", -1, native)})
    assert sorted(map(tuple, steps.collect()), key=repr) == sorted(map(tuple, nested.collect()), key=repr)
