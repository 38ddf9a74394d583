"""State before a transaction, funding and legs, against slow loops and worked cases."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketflow.functions import amounts as A
from marketflow.operators import book as B
from marketflow.operators import funds as FU
from marketflow.operators import ladder as LD
from marketflow.operators import legs as LG
from marketflow.operators.select import build_intents, normalise_metadata, resolve_ids
from marketflow.sources.readers import parse_metadata


def issued(value, currency="TOK", issuer="ISS"):
    return {"currency": currency, "issuer": issuer, "value": value}


def metadata(spark, records):
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "value string")
    return resolve_ids(normalise_metadata(parse_metadata(df, "value")))


def record(hash_, index, nodes=(), ledger=10, **fields):
    return {"status": "ok", "result": {"hash": hash_, "ledger_index": ledger, "meta": {"TransactionIndex": index, "AffectedNodes": list(nodes)}, **fields}}


def offer(kind, index, final=None, previous=None, new=None):
    body = {"LedgerEntryType": "Offer", "LedgerIndex": index}
    for name, value in (("FinalFields", final), ("PreviousFields", previous), ("NewFields", new)):
        if value is not None:
            body[name] = value
    return {kind: body}


DIRECTORY = "0" * 48 + "4F00000000000001"


def test_version_intervals_match_a_replay(spark):
    """Random ledgers with several changes to one offer inside a transaction."""
    rng = random.Random(11)
    boundary, changes, targets, expected = [], [], [], set()
    for ledger in range(30):
        state = {}
        for o in range(4):
            if rng.random() < 0.6:
                boundary.append((ledger, f"o{o}", f"b{o}"))
                state[f"o{o}"] = f"b{o}"
        for index in range(8):
            if rng.random() < 0.5:
                targets.append((ledger, index))
                expected |= {(ledger, index, o, s) for o, s in state.items()}
            for step in range(rng.randrange(4)):
                o = f"o{rng.randrange(5)}"
                new = None if rng.random() < 0.3 else f"s{index}.{step}"
                changes.append((ledger, index, step, o, new))
                state.pop(o, None) if new is None else state.__setitem__(o, new)
    b = spark.createDataFrame(boundary, "ledger_index bigint, offer_id string, state string")
    c = spark.createDataFrame(changes, "ledger_index bigint, transaction_index bigint, step int, offer_id string, state string")
    t = spark.createDataFrame(targets, "ledger_index bigint, transaction_index bigint")
    versions = B.version_intervals(b, c, ["ledger_index"], ["offer_id"])
    for span in (2, 1024):
        got = B.state_before(t, versions, ["ledger_index"], span=span)
        rows = [(r["ledger_index"], r["transaction_index"], r["offer_id"], r["state"]) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == expected


def test_state_before_copies_versions_by_targets_not_positions(spark, split_groups):
    """Positions far apart, ties, open ends, empty ranges and groups in blocks; before, a version was copied once per 1,024 positions."""
    rng = random.Random(5)
    far = 10**12
    targets = [(g, rng.randrange(60) * far) for g in range(3) for _ in range(50)] + [(1, None)]
    versions = []
    for g in range(4):
        for e in range(3):
            ends = sorted(rng.sample(range(60), 12))
            versions += [(g, f"e{e}", a * far, b * far if b < ends[-1] else None, float(a)) for a, b in zip(ends, ends[1:])]
    t = spark.createDataFrame(targets, "g bigint, transaction_index bigint")
    v = spark.createDataFrame(versions, "g bigint, entity string, from_index bigint, to_index bigint, state double")
    expected = sorted((g, i, e, s) for g, i in targets for h, e, a, b, s in versions if g == h and i is not None and a < i and (b is None or i <= b))
    for span in (1, 4, 1024):
        got = B.state_before(t, v, ["g"], span=span)
        assert got.columns == ["g", "transaction_index", "entity", "from_index", "to_index", "state"]
        assert sorted((r["g"], r["transaction_index"], r["entity"], r["state"]) for r in got.collect()) == expected


def test_shared_funds_go_to_the_better_offer(spark):
    """Two offers of twenty, funds of 13.5, the worse price listed first."""
    rows = [("w", 20.0, 2, 30.0, 13.5), ("b", 20.0, 1, 10.0, 13.5)]
    df = spark.createDataFrame(rows, "offer string, size double, quality int, pays double, funds double").withColumn("acct", F.lit("A"))
    out = FU.allocate_funds(df, ["acct"], ["quality", "offer"], bounded=True)
    out = out.withColumn("input", FU.input_for_output(F.col("allocated"), F.col("size"), F.col("pays"), F.col("pays") / F.col("size")))
    got = {r["offer"]: (r["allocated"], r["input"]) for r in out.collect()}
    assert got == {"b": (13.5, 6.75), "w": (0.0, 0.0)}


def test_funded_caps_skip_keeps_the_balance(spark):
    """An offer whose book size is below its cap is passed over and leaves the funds to the next."""
    book = spark.createDataFrame([("A", "o1", 1, 5, 30), ("A", "o2", 2, 25, None), ("A", "o4", 4, 50, None)], "account string, offer_id string, sequence bigint, size bigint, funds bigint")
    all_offers = spark.createDataFrame([("A", 1, 20), ("A", 2, 25), ("A", 3, 4), ("A", 4, 50)], "account string, sequence bigint, size bigint")
    got = {r["offer_id"]: int(r["cap"]) for r in FU.funded_caps(book, all_offers, key=["account"]).collect()}
    assert got == {"o2": 25, "o4": 1}


def test_equal_prices_keep_directory_order(spark):
    df = spark.createDataFrame([("x", 5, 2), ("a", 5, 3), ("z", 5, 1), ("m", 4, 9)], "offer string, quality int, position int").withColumn("book", F.lit(1))
    ranked = LD.rank_book(df, ["book"]).orderBy("book_rank")
    assert [r["offer"] for r in ranked.collect()] == ["m", "z", "x", "a"]


def test_offer_log_and_own_pre_image(spark):
    gets, pays = issued("10"), "5000000"
    fields = {"Account": "A", "Sequence": 1, "BookDirectory": DIRECTORY}
    records = [
        record("t0", 0, [offer("ModifiedNode", "O1", {**fields, "TakerGets": issued("6"), "TakerPays": "3000000"}, {"TakerGets": gets, "TakerPays": pays})]),
        record("t1", 1, [offer("DeletedNode", "O1", {**fields, "TakerGets": issued("0"), "TakerPays": "0"}, {"TakerGets": issued("6"), "TakerPays": "3000000"}),
                         offer("CreatedNode", "O2", new={**fields, "Sequence": 2, "TakerGets": issued("1"), "TakerPays": "1"})]),
        record("t2", 2, [offer("DeletedNode", "O2", {**fields, "TakerGets": issued("1"), "TakerPays": "1"}, {})]),
    ]
    meta = metadata(spark, records)
    changes = B.offer_changes(meta, ("TOK", "ISS"))
    assert {(r["tx_hash"], r["offer_id"], r["action"]) for r in changes.collect()} == {("T0", "O1", "upsert"), ("T1", "O1", "delete"), ("T1", "O2", "upsert"), ("T2", "O2", "delete")}
    assert [r["offer_id"] for r in B.deleted_without_fill(meta).collect()] == ["O2"]
    boundary = spark.createDataFrame(
        [(9, "gets_issued", "O1", 0, "A", 1, DIRECTORY, json.dumps(gets), pays, "99", None, None), (9, "gets_issued", "O9", 1, "B", 9, DIRECTORY, json.dumps(issued("7")), "7", "7", None, None)],
        "ledger_index bigint, side string, offer_id string, position bigint, account string, sequence bigint, book_directory string, taker_gets string, taker_pays string, owner_funds string, taker_gets_funded string, taker_pays_funded string",
    )
    targets = spark.createDataFrame([("T0", 10, 0), ("T1", 10, 1), ("T2", 10, 2)], "tx_hash string, ledger_index bigint, transaction_index bigint")
    rows = B.book_before(targets, boundary, changes).withColumn("value", F.get_json_object("taker_gets", "$.value")).collect()
    got = {(r["tx_hash"], r["offer_id"]): (r["value"], r["owner_funds"], r["own_pre_image"]) for r in rows}
    assert got[("T0", "O1")][0] == "10" and got[("T0", "O1")][2]
    assert got[("T1", "O1")] == ("6", None, True)  # amounts changed, so the published funds are gone
    assert ("T2", "O1") not in got and got[("T2", "O2")][2]
    assert all(got[(t, "O9")] == ("7", "7", False) for t in ("T0", "T1", "T2"))


def test_partial_fill_keeps_the_place(spark):
    """A filled offer stays ahead of its equals; one that is deleted and made again queues behind them."""
    fields = {"Account": "A", "Sequence": 1, "BookDirectory": DIRECTORY}
    fill = lambda a, b: offer("ModifiedNode", "O1", {**fields, "TakerGets": issued(b), "TakerPays": b}, {"TakerGets": issued(a), "TakerPays": a})
    gone = offer("DeletedNode", "O1", {**fields, "TakerGets": issued("8"), "TakerPays": "8"}, {})
    made = offer("CreatedNode", "O1", new={**fields, "TakerGets": issued("3"), "TakerPays": "3"})
    unseen = [offer("DeletedNode", f"N{i}", {**fields, "TakerGets": issued("1"), "TakerPays": "1"}, {}) for i in (2, 1)]
    records = [record("t0", 0, [fill("10", "9")]), record("t1", 1, [fill("9", "8")]), record("t2", 2, [gone]), record("t3", 3, [made]), record("t4", 4, [fill("3", "2")]), record("t5", 5, unseen)]
    boundary = spark.createDataFrame(
        [(9, "gets_issued", "O1", 0, "A", 1, DIRECTORY, json.dumps(issued("10")), "10", None, None, None), (9, "gets_issued", "O9", 1, "B", 9, DIRECTORY, json.dumps(issued("7")), "7", None, None, None)],
        "ledger_index bigint, side string, offer_id string, position bigint, account string, sequence bigint, book_directory string, taker_gets string, taker_pays string, owner_funds string, taker_gets_funded string, taker_pays_funded string",
    )
    targets = spark.createDataFrame([(f"T{i}", 10, i) for i in range(6)], "tx_hash string, ledger_index bigint, transaction_index bigint")
    rows = B.book_before(targets, boundary, B.offer_changes(metadata(spark, records))).collect()
    queue = {f"T{i}": [r["offer_id"] for r in sorted(rows, key=lambda r: (r["quality"], r["position"])) if r["tx_hash"] == f"T{i}"] for i in range(6)}
    assert queue == {"T0": ["O1", "O9"], "T1": ["O1", "O9"], "T2": ["O1", "O9"], "T3": ["O9"], "T4": ["O9", "O1"], "T5": ["O9", "O1", "N2", "N1"]}


def test_large_balance_is_not_zero(spark):
    meta = metadata(spark, [record("t0", 0, [line("H", "ISS", "5", "3e21")]), record("t1", 1, [line("H", "ISS", "3e21", "1")])])
    got = {(r["tx_hash"], r["account"]): (r["funds"], int(r["units"]) * 10 ** (r["exponent"] + 20)) for r in B.funds_changes(meta).collect()}
    assert got[("T0", "H")] == (None, 3 * 10**41) and got[("T0", "ISS")] == (0, 0)
    assert got[("T1", "H")] == (1, 10**20)


def test_account_movement_includes_the_owners_fee(spark):
    """The balance fell by what the owner paid (10.5), of which the taker got 10."""
    def amount(value):
        exponent = Decimal(str(value)).adjusted() - 15  # sixteen digits
        return Decimal(str(value)).scaleb(-exponent), exponent

    kind = "struct<units:decimal(38,0),exponent:int>"
    side = f"struct<units:decimal(38,0),exponent:int,pre:{kind},post:{kind},state_change:string,state_source:string>"
    leg = lambda source, pre, post, value: (*amount(value), amount(pre), amount(post), "decrease", source)
    real = spark.createDataFrame(
        [(t, "CLOB", "O1", "M", leg(source, 100, 100 - value, value), leg("offer_node", 50, 30, 20)) for t, source, value in (("A", "account_delta", 10.5), ("B", "offer_node", 10))],
        f"tx_hash string, src string, source_id string, owner string, out {side}, `in` {side}",
    )
    model = spark.createDataFrame([(t, "CLOB", "O1", 1, amount(10), amount(20), amount(10.5)) for t in "AB"], f"tx_hash string, src string, source_id string, leg_no int, out {kind}, `in` {kind}, owner_out {kind}")
    targets = spark.createDataFrame([("A", "XRP", "TOK"), ("B", "XRP", "TOK")], "tx_hash string, in_currency string, out_currency string")
    paid = {r["tx_hash"]: r["out_side_exact_match"] for r in LG.compare_legs(targets, model, real).collect()}
    given = {r["tx_hash"]: r["out_side_exact_match"] for r in LG.compare_legs(targets, model.drop("owner_out"), real).collect()}
    assert paid == {"A": True, "B": True} and given == {"A": False, "B": True}


def line(low, high, before, after, kind="ModifiedNode"):
    limit = lambda who: issued("0", "TOK", who)
    body = {"LedgerEntryType": "RippleState", "LedgerIndex": "L", "FinalFields": {"Balance": issued(after, "TOK", "ONE"), "LowLimit": limit(low), "HighLimit": limit(high)}, "PreviousFields": {"Balance": issued(before, "TOK", "ONE")}}
    return {kind: body}


def test_drained_line_shows_in_the_next_transaction(spark):
    meta = metadata(spark, [record("t0", 0, [line("H", "ISS", "5", "0")]), record("t1", 1, [line("H", "ISS", "0", "3", "DeletedNode")]), record("t2", 2, [])])
    asked = spark.createDataFrame([(f"T{i}", 10, i, "H", "TOK", "ISS") for i in range(3)], "tx_hash string, ledger_index bigint, transaction_index bigint, account string, currency string, issuer string")
    lines = spark.createDataFrame([(9, "H", "TOK", "ISS", 5.0), (9, "H", "TOK", "ISS", 4.0)], "ledger_index bigint, account string, currency string, issuer string, funds double").withColumn("funds", F.col("funds").cast("decimal(38,18)"))
    out = B.funds_before(asked, B.funds_seeds(lines.limit(0), lines), B.funds_changes(meta))
    assert {r["tx_hash"]: float(r["funds"]) for r in out.collect()} == {"T0": 4.0, "T1": 0.0, "T2": 0.0}


def intents(spark, **fields):
    rows = build_intents(metadata(spark, [record("x", 0, **fields)])).collect()
    return rows[0] if rows else None


PAY = {"TransactionType": "Payment", "Account": "A", "Amount": issued("1.2"), "SendMax": "1500000"}
OFFER = {"TransactionType": "OfferCreate", "Account": "A", "TakerGets": "1", "TakerPays": issued("2")}


def test_partial_payment_with_minimum(spark):
    got = intents(spark, **PAY, Flags=0x00030000, DeliverMin=issued("1.0"), Paths=[[{"currency": "TOK"}]])
    assert got["reject_reason"] is None
    assert (got["in_currency"], got["out_currency"], got["partial_allowed"], got["no_direct"]) == ("XRP", "TOK", True, True)
    assert (got["paths_count"], got["paths_external"], float(got["min_amount"]["value"])) == (1, False, 1.0)


@pytest.mark.parametrize(
    "fields,reason",
    [
        ({**OFFER, "Flags": 0x00060000}, "conflicting_flags"),
        ({**OFFER, "Flags": 0x00100000}, "unsupported_flags"),
        ({**OFFER, "TakerGets": issued("5"), "TakerPays": issued("2")}, "same_asset"),
        ({**OFFER, "TakerGets": "0"}, "invalid_amount"),
        ({**OFFER, "OfferSequence": 0}, "invalid_cancel_sequence"),
        ({**PAY, "DeliverMin": issued("1")}, "minimum_without_partial"),
        ({**PAY, "Flags": 0x00020000, "DeliverMin": issued("1", "USD")}, "minimum_asset_mismatch"),
        ({**PAY, "Flags": 0x00020000, "DeliverMin": issued("1.3")}, "minimum_above_maximum"),
        ({**OFFER, "Flags": 0x80000000}, None),
    ],
)
def test_rejected_intents(spark, fields, reason):
    assert intents(spark, **fields)["reject_reason"] == reason


def test_derived_send_limit_and_external_path(spark):
    fields = {k: v for k, v in PAY.items() if k != "SendMax"}
    got = intents(spark, **fields, Paths=[[{"currency": "USD"}], [{"account": "r"}]])
    assert (got["in_currency"], got["in_issuer"], got["paths_external"], got["paths_count"]) == ("TOK", "A", True, 2)
    assert A.NATIVE == "XRP" and intents(spark, TransactionType="TrustSet", Account="A") is None


KIND = "struct<units:decimal(38,0),exponent:int>"
SIDE = f"struct<units:decimal(38,0),exponent:int,pre:{KIND},post:{KIND},state_change:string,state_source:string>"


def native_side(pre, post):
    """A native side that gives ``pre - post`` drops."""
    return Decimal(pre - post), -6, (Decimal(pre), -6), (Decimal(post), -6), "decrease", "offer_node"


def compared_legs(spark, model, real, targets):
    """``model``: (tx, src, source, number, out, in); ``real``: (tx, src, source, out before, out after, in before, in after)."""
    drops = lambda n: None if n is None else (Decimal(n), -6)
    models = spark.createDataFrame([(t, k, i, n, drops(o), drops(g)) for t, k, i, n, o, g in model], f"tx_hash string, src string, source_id string, leg_no int, out {KIND}, `in` {KIND}")
    reals = spark.createDataFrame([(t, k, i, native_side(a, b), native_side(c, d)) for t, k, i, a, b, c, d in real], f"tx_hash string, src string, source_id string, out {SIDE}, `in` {SIDE}")
    wanted = spark.createDataFrame([(t, "XRP", "XRP") for t in targets], "tx_hash string, in_currency string, out_currency string")
    return models, reals, LG.compare_legs(wanted, models, reals)


def test_legs_are_compared_inside_a_transaction(spark):
    model = [
        ("one", "CLOB", "O", 1, 4, 8), ("one", "CLOB", "O", 2, 6, 12),  # two model legs face one real leg
        ("rank", "CLOB", "O", 1, 7, 1), ("rank", "CLOB", "O", 2, 3, 1),  # two and two pair by size, not by number
        ("sizes", "CLOB", "O", 1, 1, 1), ("sizes", "CLOB", "O", 2, 1, 1), ("sizes", "CLOB", "O", 3, 1, 1),
        ("missing", "CLOB", "O", 1, 5, 5), ("pools", "AMM", "p", 1, 5, 6), ("null", None, None, 1, 5, 5), ("amount", "CLOB", "O", 1, 5, 5),
    ]
    real = [
        ("one", "CLOB", "O", 10, 0, 20, 0), ("rank", "CLOB", "O", 9, 2, 5, 4), ("rank", "CLOB", "O", 3, 0, 4, 3),
        ("sizes", "CLOB", "O", 2, 1, 2, 1), ("sizes", "CLOB", "O", 1, 0, 1, 0),
        ("extra", "CLOB", "X", 5, 0, 5, 0), ("pools", "AMM", "q", 5, 0, 6, 0), ("null", None, None, 5, 0, 5, 0), ("amount", "CLOB", "O", 9, 5, 9, 4),
    ]
    models, reals, compared = compared_legs(spark, model, real, ["one", "rank", "sizes", "missing", "extra", "pools", "null", "amount", "none"])
    rows = {r["tx_hash"]: r for r in compared.collect()}
    assert len(rows) == 9
    assert {t for t, r in rows.items() if r["strict_exact_match"]} == {"one", "rank", "pools", "null", "none"}
    assert {t for t, r in rows.items() if r["structure_match"]} == {"rank", "pools", "null", "none", "amount"}
    amount = rows["amount"]
    assert (amount["first_failed_kind"], amount["first_failed_id"], amount["failed_side"]) == ("CLOB", "O", "out")
    assert amount["in_side_exact_match"] and not amount["out_side_exact_match"]
    assert amount["out_signed_err"] == pytest.approx(-0.25) and amount["total_out_diff"] == pytest.approx(1e-6)
    assert rows["sizes"]["out_signed_err"] is None and rows["missing"]["in_signed_err"] is None
    assert (rows["none"]["model_leg_count"], rows["none"]["total_in_diff"], rows["none"]["in_signed_err"]) == (0, 0.0, 0.0)
    paired = {(r["tx_hash"], r["leg_rank"]): [int(leg["out"]["units"]) for leg in r["model_legs"]] if r["model_legs"] else None for r in LG.pair_legs(models, reals).collect()}
    assert paired[("one", 1)] == [4, 6] and paired[("rank", 1)] == [3] and paired[("rank", 2)] == [7]
    assert paired[("sizes", 1)] is None and paired[("extra", 1)] is None
    whole = {r["tx_hash"]: r for r in LG.structure_match(models, reals).collect()}
    assert (whole["extra"]["model_leg_count"], whole["extra"]["identity_match"], whole["pools"]["structure_match"], whole["sizes"]["pairable"]) == (0, False, True, False)


def test_comparison_shuffles_each_input_once(spark):
    _, _, compared = compared_legs(spark, [("a", "CLOB", "O", 1, 1, 1)], [("a", "CLOB", "O", 1, 0, 1, 0)], ["a"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = compared.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(tx_hash") == text.count("Exchange ") == 3 and "Window" not in text


@pytest.mark.parametrize("most", [100, 0])
def test_only_asked_balances_go_on(spark, monkeypatch, most):
    """Changes of balances nobody asks for are left out where the asked ones are few; what is found is the same."""
    monkeypatch.setattr(B, "MAX_ASKED", most)
    meta = metadata(spark, [record("t0", 0, [line("H", "ISS", "5", "4"), line("K", "ISS", "5", "2")]), record("t1", 1, [line("K", "ISS", "2", "1")]), record("t2", 2, [line("H", "ISS", "4", "3")])])
    changes, none = B.funds_changes(meta), "ledger_index bigint, account string, currency string, issuer string, funds decimal(38,18)"
    asked = spark.createDataFrame([("T1", 10, 1, "H", "TOK", "ISS"), ("T2", 10, 2, "H", "TOK", "ISS"), ("T2", 10, 2, "Q", "TOK", None)], "tx_hash string, ledger_index bigint, transaction_index bigint, account string, currency string, issuer string")
    kept, seeds = B.asked_changes(changes, asked), B.funds_seeds(*[spark.createDataFrame([], none)] * 2)
    assert kept.count() == (2 if most else changes.count()) and changes.count() == 8
    found = [B.funds_before(asked, seeds, c) for c in (changes, kept)]
    assert found[0].columns[:6] == asked.columns and sorted(map(tuple, found[0].collect()), key=str) == sorted(map(tuple, found[1].collect()), key=str)
    assert {(r["tx_hash"], r["account"]): r["funds"] and float(r["funds"]) for r in found[1].collect()} == {("T1", "H"): 4.0, ("T2", "H"): 4.0, ("T2", "Q"): None}
