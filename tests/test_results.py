"""Distinct transactions of same-fill roll-ups and result totals, against plain counting."""

import random

from marketflow.operators import samefill as SF

SCHEMA = "pair string, measurement string, tx_hash string, found boolean, violation boolean, under_spent boolean"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rollup_counts_each_transaction_once_per_level(spark):
    rng = random.Random(11)
    rows = [
        (rng.choice(["p", "q", None]), rng.choice(["m", "n", None]), rng.choice([None, "", *[f"t{i}" for i in range(25)]]),
         rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.2)
        for _ in range(400)
    ]
    frame = spark.createDataFrame(rows + rows[:50], SCHEMA)
    rows += rows[:50]
    got = {(r["level"], r["pair"], r["measurement"]): r for r in SF.same_fill_global(frame).collect()}
    keys = {(0, r[0], r[1]) for r in rows} | {(1, r[0], None) for r in rows} | {(3, None, None)}
    assert set(got) == keys
    for level, pair, measurement in keys:
        mine = [r for r in rows if (level == 3 or r[0] == pair) and (level > 0 or r[1] == measurement)]
        row = got[level, pair, measurement]
        assert (row["n"], row["improved"]) == (len(mine), sum(r[3] for r in mine))
        assert (row["constraint_violations"], row["under_spent"]) == (sum(r[4] for r in mine), sum(r[5] for r in mine))
        assert row["unique_tx"] == len({r[2] for r in mine} - {None})
        assert row["improved_tx"] == len({r[2] for r in mine if r[3]} - {None})
    assert plan(SF.same_fill_global(frame)).count("Expand") == 1


def test_result_totals_count_transactions_without_expand(spark):
    from marketflow.sources.schemas import SAME_FILL, parsed

    schema = parsed(f"pair string, {SAME_FILL}")
    base = {"improvement_type": "x", "best": {"improvement_bps": "5"}, "gain_decomposition": {"total_gain": "2", "total_gain_bps": "4"}}
    rows = [("p", "a", True), ("p", "a", False), ("p", "b", False), ("p", "", True), ("p", None, True), (None, "a", True)]
    frame = spark.createDataFrame([{**base, "pair": p, "tx_hash": t, "found_improvement": f} for p, t, f in rows], schema)
    out = SF.result_summary(frame, ["pair"])
    got = {r["pair"]: (r["measurement_count"], r["improved_count"], r["unchanged_count"], r["unique_tx_count"], r["improved_tx_count"], r["total_gain"]) for r in out.collect()}
    assert got == {"p": (5, 3, 2, 2, 1, 10.0), None: (1, 1, 0, 1, 1, 2.0)}
    assert "Expand" not in plan(out)
    empty = SF.result_summary(frame.limit(0)).collect()
    assert [(r["measurement_count"], r["unique_tx_count"], r["total_gain"]) for r in empty] == [(0, 0, None)]


def test_submitted_fields_land_narrow_rows_only(spark, monkeypatch):
    """Fills are not landed whole, and what the summary reads several times is landed."""
    from marketflow.plans import derive
    from marketflow.plans.twins import results

    root = "/root/testdata/sf0.001"
    monkeypatch.setattr(derive, "_LANDED", {})
    got = results.submitted_fields(spark, root)
    assert sorted(name for _, _, name in derive._LANDED) == ["rated", "submitted"]
    assert all("counterfactual_comparison" not in spark.read.parquet(folder).columns for folder in derive._LANDED.values())
    text = plan(got)
    assert "Relation [tx_type#" in text and text.count("Relation [") == text.count("Relation [tx_type#")
    # The same rows from whole fills, filtered before they are weighed.
    kept = results._kept(spark, root).withColumn("tx_hash", results.F.regexp_replace("tx_hash", "^R", "A"))
    whole = SF.submitted_transactions(kept, derive.metadata_heads(spark, root))
    landed = spark.read.parquet(next(f for (_, _, n), f in derive._LANDED.items() if n == "submitted"))
    assert landed.count() > 0 and landed.exceptAll(whole).isEmpty() and whole.exceptAll(landed).isEmpty()


def test_rate_ranges_list_every_change_of_an_issuer(spark):
    from marketflow.operators import temporal as TP

    targets = spark.createDataFrame([(10,), (20,)], "ledger_index bigint")
    # A: set before, to the same rate, anew twice in one ledger, taken away, after the window; B: before only; C: never; E: not asked for.
    settings = [("A", 9, 0, "s", 5), ("A", 10, 3, "t", 5), ("A", 12, 1, "u", 7), ("A", 12, 4, "v", 8), ("A", 20, 2, "w", 0), ("A", 21, 0, "x", 9), ("B", 3, 0, "y", 6), ("E", 11, 0, "z", 4)]
    changes = spark.createDataFrame(settings, "issuer string, ledger_index bigint, transaction_index bigint, tx_hash string, transfer_rate bigint")
    issuers = spark.createDataFrame([("A",), ("B",), ("C",), ("A",), (None,)], "issuer string")
    one, names = 1_000_000_000, ["issuer", "first_ledger", "first_index", "last_ledger", "last_index", "tx_hash", "n_changes", "status", "transfer_rate"]
    want = [
        ("A", 10, -1, 12, 1, None, 4, "changed_inside", 5), ("A", 12, 1, 12, 4, "u", 4, "changed_inside", 7), ("A", 12, 4, 20, 2, "v", 4, "changed_inside", 8),
        ("A", 20, 2, 20, None, "w", 4, "changed_inside", one), ("B", 10, -1, 20, None, None, 0, "single", 6), ("C", 10, -1, 20, None, None, 0, "single", one)]
    rates = TP.bound_rates(issuers, changes, TP.ledger_bounds(targets))
    assert sorted(tuple(r) for r in rates.collect()) == [("A", 5, one), ("B", 6, 6), ("C", one, one)]
    got = lambda: sorted((tuple(r) for r in TP.rate_ranges(targets, changes, rates).select(*names).collect()), key=lambda t: t[:3])
    assert got() == want
    spark.conf.set("spark.marketflow.maxGroupRows", "3")
    try:
        assert got() == want
    finally:
        spark.conf.unset("spark.marketflow.maxGroupRows")
    differing = TP.rate_ranges(targets, changes, spark.createDataFrame([("B", 6, 7)], "issuer string, start_rate bigint, end_rate bigint"))
    assert [tuple(r) for r in differing.select(*names).collect()] == [("B", 10, -1, 20, None, None, 0, "ends_differ", None)]
