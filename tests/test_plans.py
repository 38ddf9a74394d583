"""Physical plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketflow.operators.scan import top_rows
from marketflow.operators.select import window_filter

ROOT = "/root/testdata/sf0.001"

# Joins without an equality are allowed only against a one-row aggregate.
ONE_ROW_JOINS = {"rate_ranges"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_are_cut_before_the_shuffle(spark):
    text = plan(top_rows(spark.read.parquet(f"{ROOT}/part.parquet"), ["p_brand"], ["-p_retailprice"], 3))
    assert text.count("WindowGroupLimit") == 2


def test_window_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{ROOT}/orders.parquet")
    text = plan(window_filter(df, ledger=(10, 20), ledger_col="o_orderkey").select("o_custkey"))
    assert "GreaterThanOrEqual(o_orderkey,10)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


@pytest.mark.parametrize("name", ["tx_sequence", "rate_join", "asof_value", "state_before", "depth_fill", "rate_interval", "pool_quote_asof", "clean_book", "materiality", "breakdown", "rate_ranges"])
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    found = "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text
    assert found == (name in ONE_ROW_JOINS)


def test_metadata_columns_are_pruned(spark):
    from marketflow.plans import derive

    text = plan(derive.metadata(spark, ROOT).select(F.col("result.TransactionType")))
    assert "AffectedNodes" not in text


def test_a_null_group_stays(spark):
    from marketflow.operators import fit

    errors = spark.createDataFrame([(None, "t1", 0.5), (None, "t2", -0.1), ("a", "t3", 0.2)], "pair string, tx_hash string, err double")
    expected = spark.createDataFrame([(None, 2), ("a", 1)], "pair string, expected_count int")
    got = {r["pair"]: (r["available"], r["complete"], r["min_err"], r["max_err"]) for r in fit.amount_only_range(errors, ["pair"], "err", expected).collect()}
    assert got == {None: (2, True, 0.1, 0.5), "a": (1, True, 0.2, 0.2)}
    joined = fit.join_groups(errors.groupBy("pair").count(), errors.groupBy("pair").agg({"err": "max"}), ["pair"])
    assert joined.count() == 2 and joined.columns == ["pair", "count", "max(err)"]
