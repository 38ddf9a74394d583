"""Derived records: the columns equal the text they stand for, and queries write no text."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketflow.operators import book, legs
from marketflow.plans import churn, derive
from marketflow.sources.readers import parse_metadata, read_metadata

ROOT = "/root/testdata/sf0.001"


def test_records_equal_their_text(spark):
    read, made = read_metadata(spark, derive.metadata_lines(spark, ROOT)), derive.metadata_records(spark, ROOT)
    assert read.schema.simpleString() == made.schema.simpleString()
    assert read.count() == 1500 and read.exceptAll(made).isEmpty() and made.exceptAll(read).isEmpty()


@pytest.mark.parametrize("build", [derive.metadata, derive.intents, churn.metadata])
def test_records_are_not_written_as_text(spark, build, monkeypatch):
    monkeypatch.setattr(derive, "_LANDED", {})
    assert build(spark, ROOT).limit(1).count() == 1
    assert not [name for _, _, name in derive._LANDED if name.endswith("lines")]


def test_heads_land_nothing(spark, monkeypatch):
    monkeypatch.setattr(derive, "_LANDED", {})
    heads, whole = derive.metadata_heads(spark, ROOT), derive._metadata(spark, ROOT)
    ids = ["tx_hash", "ledger_index", "transaction_index", "status", "result.TransactionType", "result.Paths", "result.Amount"]
    assert heads.select(*ids).exceptAll(whole.select(*ids)).isEmpty() and heads.count() == 1500
    assert derive._LANDED == {}


def test_unreadable_text_stops_the_job(spark):
    bad = spark.createDataFrame([('{"result":',)], "value string")
    assert parse_metadata(bad, "value").first()["result"] is None
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_metadata(bad, "value", on_bad="fail").collect()


def test_legs_are_shuffled_without_their_order_keys(spark):
    """What orders a leg repeats its amounts: it is made of the gathered legs, not gathered."""
    end = "struct<units: decimal(38,0), exponent: int>"
    side = f"struct<units: decimal(38,0), exponent: int, pre: {end}, post: {end}, state_change: string, state_source: string>"
    model = spark.createDataFrame([], f"tx_hash string, src string, source_id string, leg_no int, out {end}, `in` {end}")
    real = spark.createDataFrame([], f"tx_hash string, src string, source_id string, owner string, out {side}, `in` {side}")
    for arrays in (legs._model_arrays(model), legs._real_arrays(real)):
        first, below = arrays._jdf.queryExecution().optimizedPlan().toString().split("\n", 1)
        assert "collect_list(_l#" in first and "place, struct(" in first and "place, struct(" not in below


@pytest.mark.parametrize("read", [legs.real_offer_legs, legs.real_pool_legs, legs.source_funds])
def test_records_with_their_intents_need_no_join(spark, read, monkeypatch):
    joined = read(derive.metadata(spark, ROOT), derive.intents(spark, ROOT))
    monkeypatch.setattr(derive, "_LANDED", {})
    beside = read(derive.records(spark, ROOT))
    plan = beside._jdf.queryExecution().optimizedPlan().toString()
    # The orders are dealt out once; no record, offer or line is shuffled or landed.
    assert "Join " not in plan and plan.count("RepartitionByExpression") == 1 and derive._LANDED == {}
    assert beside.count() > 0 and beside.exceptAll(joined).isEmpty() and joined.exceptAll(beside).isEmpty()


def test_leg_totals_shuffle_once(spark):
    side = "struct<units: decimal(38,0), exponent: int>"
    of = lambda units, exponent: (Decimal(units), exponent)
    rows = spark.createDataFrame([("T0", of(5, 0), of(2, 1)), ("T0", of(1, 0), of(3, 0)), ("T1", of(4, 0), None)], f"tx_hash string, out {side}, `in` {side}")
    totals = legs.leg_totals(rows, "out", "in")
    assert totals._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, totals.collect())) == [("T0", 6.0, 23.0), ("T1", 4.0, None)]


def test_comparison_exchanges_only_orders(spark, monkeypatch):
    """Orders are dealt out by transaction before they grow; no leg, target or balance is shuffled or landed."""
    monkeypatch.setattr(derive, "_LANDED", {})
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derive._compared(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") > 0
    assert derive._LANDED == {}


def test_records_dealt_out_by_transaction_keep_their_ids(spark, monkeypatch):
    monkeypatch.setattr(derive, "DEALT_ROWS", 100)
    ids = ["tx_hash", "ledger_index", "transaction_index"]
    dealt = derive._metadata(spark, ROOT, nodes=False, by_tx=True)
    assert dealt.rdd.getNumPartitions() == 15
    assert dealt.select(*ids).exceptAll(derive.metadata_heads(spark, ROOT).select(*ids)).isEmpty()
    assert dealt.count() == 1500 and dealt.filter(F.col("tx_hash") != F.upper("result.hash")).isEmpty()


@pytest.mark.parametrize("read", [book.offer_changes, book.deleted_without_fill, book.funds_changes])
def test_node_logs_land_and_shuffle_no_record(spark, read, monkeypatch):
    landed = read(derive.metadata(spark, ROOT))
    monkeypatch.setattr(derive, "_LANDED", {})
    made = read(derive.metadata_rows(spark, ROOT))
    assert made.count() > 0 and made.exceptAll(landed).isEmpty() and landed.exceptAll(made).isEmpty() and derive._LANDED == {}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # One pass over the records, whose orders are dealt out once.
    assert plan.count("RepartitionByExpression") == 1 and "Union" not in plan
