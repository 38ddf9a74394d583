"""The assembled book, legs found inside a record, and amounts beyond DECIMAL(38,18)."""

import json

import pytest
from pyspark.sql import functions as F
from test_book import DIRECTORY, issued, line, metadata, offer, record

from marketflow.operators import book as B
from marketflow.operators import keys as K
from marketflow.operators import legs as LG
from marketflow.operators import prebook as PB
from marketflow.operators.select import build_intents
from marketflow.plans import churn as C
from marketflow.plans import derive as D

BOUNDARY = "ledger_index bigint, side string, offer_id string, position bigint, account string, sequence bigint, book_directory string, taker_gets string, taker_pays string, owner_funds string, taker_gets_funded string, taker_pays_funded string"
TARGETS = "tx_hash string, ledger_index bigint, transaction_index bigint"
LINES = "ledger_index bigint, account string, currency string, issuer string, funds string"


def listed(offer_id, position, account, value, funds=None, cap=None):
    return (9, "gets_issued", offer_id, position, account, position, DIRECTORY, json.dumps(issued(value, "TOK", "ISS")), "7", funds, cap, None)


def assembled(spark, records, boundary, lines=(), count=3, **options):
    targets = spark.createDataFrame([(f"T{i}", 10, i) for i in range(count)], TARGETS)
    rows = PB.prebook(targets, spark.createDataFrame(boundary, BOUNDARY), spark.createDataFrame(list(lines), LINES), metadata(spark, records), ("TOK", "ISS"), **options)
    value = lambda r: None if r["owner_units"] is None else float(r["owner_units"].scaleb(r["owner_exponent"]))
    return {(r["tx_hash"], r["offer_id"]): (r["book_rank"], value(r), r["taker_gets_funded"]) for r in rows.collect()}


def test_running_funds_replace_published_ones_and_the_floor_is_shared(spark):
    records = [record("t0", 0, [line("H", "ISS", "5", "3")]), record("t1", 1, [line("H", "ISS", "3", "0")]), record("t2", 2, [])]
    got = assembled(spark, records, [listed("O1", 0, "H", "10", "8", "5"), listed("O2", 1, "H", "20"), listed("O3", 2, "K", "1", "9", "1")])
    assert got[("T0", "O1")] == (1, 8, None) and got[("T0", "O2")] == (2, 8, None)  # opening funds are running funds: caps end
    assert got[("T1", "O1")] == (1, 3, None) and got[("T1", "O2")] == (2, 3, None)
    assert got[("T2", "O1")] == (1, None, None) and got[("T2", "O3")] == (3, 9, None)  # a balance of zero leaves no funds


def test_lines_and_own_balances_win_and_the_best_offers_stay(spark):
    gets, pays = issued("10", "TOK", "ISS"), "7"
    fields = {"Account": "H", "Sequence": 0, "BookDirectory": DIRECTORY}
    fill = offer("ModifiedNode", "O1", {**fields, "TakerGets": issued("4", "TOK", "ISS"), "TakerPays": "3"}, {"TakerGets": gets, "TakerPays": pays})
    records = [record("t0", 0, [fill, line("H", "ISS", "6", "1")]), record("t1", 1, []), record("t2", 2, [])]
    boundary = [listed("O1", 0, "H", "10", "8"), listed("O2", 1, "K", "20"), listed("O3", 2, "N", "1", None, "4")]
    got = assembled(spark, records, boundary, [(9, "H", "TOK", "ISS", "7"), (9, "K", "TOK", "ISS", "2")], max_offers=3)
    assert got[("T0", "O1")] == (1, 6, None) and got[("T1", "O1")] == (1, 1, None)
    assert got[("T0", "O2")][1] == 2 and got[("T0", "O3")] == (3, None, "4")  # unknown funds keep the cap
    assert len(assembled(spark, records, boundary, max_offers=1)) == 3
    assert assembled(spark, records, boundary[:0]) == {("T0", "O1"): (1, 6, None), ("T1", "O1"): (1, 1, None), ("T2", "O1"): (1, 1, None)}


def test_large_and_tiny_balances_keep_their_rows(spark):
    gets, pays = issued("10", "TOK", "ISS"), "7"
    fields = {"Account": "H", "Sequence": 0, "BookDirectory": DIRECTORY}
    fill = offer("ModifiedNode", "O1", {**fields, "TakerGets": issued("4", "TOK", "ISS"), "TakerPays": "3"}, {"TakerGets": gets, "TakerPays": pays})
    for balance, shown in (("3e21", None), ("1e-19", 0.0), ("2.5", 2.5)):
        meta = metadata(spark, [record("t0", 0, [fill, line("H", "ISS", balance, "1")], TransactionType="Payment", Account="H", Amount="5", SendMax=issued("3e20", "TOK", "ISS"))])
        (own,) = B.tx_pre_funds(meta).collect()
        exact = float(own["units"]) * 10.0 ** own["exponent"]
        assert abs(exact / float(balance) - 1) < 1e-12 and (own["funds"] is None if shown is None else float(own["funds"]) == shown)
        (sent,) = LG.source_funds(meta, build_intents(meta)).collect()
        assert abs(float(sent["source_units"]) * 10.0 ** sent["source_exponent"] / float(balance) - 1) < 1e-12
        assert sent["source_limited"] == (float(balance) < 3e20) and (sent["source_funds"] is None) == (shown is None)


def test_only_balances_of_offer_owners_are_shuffled(spark):
    fields = {"Account": "H", "Sequence": 0, "BookDirectory": DIRECTORY}
    gets, pays = issued("10", "TOK", "ISS"), "7"
    fill = offer("ModifiedNode", "O1", {**fields, "TakerGets": issued("4", "TOK", "ISS"), "TakerPays": "3"}, {"TakerGets": gets, "TakerPays": pays})
    lines = [line(who, "ISS", balance, "1") for who, balance in (("H", "25"), ("Z", "30"), ("Y", "35"))]
    meta = metadata(spark, [record("t0", 0, [fill, *lines], TransactionType="Payment", Account="S", Amount="5", SendMax=issued("9", "TOK", "ISS"))])
    funds = B.tx_pre_funds(meta)
    assert [(r["offer_id"], float(r["funds"])) for r in funds.collect()] == [("O1", 25.0)]
    assert "array_contains" in funds._jdf.queryExecution().optimizedPlan().toString()


def test_a_target_without_metadata_fails(spark):
    meta = metadata(spark, [record("t0", 0)])
    targets = spark.createDataFrame([("T0", 10, 0), ("T9", 10, 9)], TARGETS)
    assert K.attach_metadata(targets.filter("tx_hash = 'T0'"), meta).count() == 1
    with pytest.raises(Exception, match="no metadata for T9"):
        K.attach_metadata(targets, meta).collect()


def test_legs_are_found_without_a_shuffle_of_nodes(spark):
    root = "/root/testdata/sf0.001"
    meta, intents = D.metadata(spark, root), D.intents(spark, root)
    for legs in (LG.real_offer_legs(meta, intents), LG.real_pool_legs(meta, intents), LG.source_funds(meta, intents)):
        plan = legs._jdf.queryExecution().optimizedPlan().toString()
        # One join with the intents; no aggregate, window or self join over the nodes of a record.
        assert plan.count("Join ") == 1 and "Aggregate" not in plan and "Window" not in plan


def test_offer_versions_take_one_pass(spark):
    root = "/root/testdata/sf0.001"
    opened = C.boundary(spark, root).withColumn("ledger_index", F.col("ledger_index") + 1)
    versions = B.offer_versions(opened, B.offer_changes(C.metadata(spark, root), ("T1", "I1")))
    plan = versions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
