"""Ordered scans: one key holds a third of the rows and spreads over blocks."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.operators import scan as SC
from marketflow.operators.fit import amount_only_range
from marketflow.operators.funds import allocate_funds
from marketflow.operators.ladder import depth_ladder
from marketflow.operators.percentiles import percentile_ceil, percentile_linear, percentile_nearest
from marketflow.operators.temporal import asof_join, change_ranges, check_order, disjoint_ranges, interval_join


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((key, i, rng.randrange(1000), rng.choice([None, 1.0, 2.0, 3.0])))
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["key", "pos", "v", "maybe"])


def same(left: pd.DataFrame, right: pd.DataFrame, by):
    left = left.sort_values(by).reset_index(drop=True)[sorted(right.columns)]
    right = right.sort_values(by).reset_index(drop=True)[sorted(right.columns)]
    pd.testing.assert_frame_equal(left, right, check_dtype=False)


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "key string, pos bigint, v bigint, maybe double")


@pytest.mark.parametrize("split", [False, True])
def test_prefix_sums_and_ranks(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed)
    out = SC.prefix_sum(df, ["key"], ["pos"], "v", "before")
    out = SC.row_rank(out, ["key"], ["-v", "pos"], "rank")
    out = SC.prefix_max(out, ["key"], ["pos"], "v", "top", inclusive=True)
    got = out.select("key", "pos", "before", "rank", "top").toPandas()
    want = skewed.sort_values(["key", "pos"]).copy()
    want["before"] = want.groupby("key")["v"].cumsum() - want["v"]
    want["top"] = want.groupby("key")["v"].cummax()
    ranked = want.sort_values(["key", "v", "pos"], ascending=[True, False, True])
    want["rank"] = ranked.groupby("key").cumcount() + 1
    same(got, want[["key", "pos", "before", "rank", "top"]], ["key", "pos"])


@pytest.mark.parametrize("split", [False, True])
def test_last_previous_and_next(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed)
    out = SC.prefix_last(df, ["key"], ["pos"], "maybe", "seen")
    out = SC.previous_row(out, ["key"], ["pos"], ["v"], "prev")
    out = SC.next_row(out, ["key"], ["pos"], ["v"], "next")
    got = out.select("key", "pos", "seen", F.col("prev.v").alias("prev"), F.col("next.v").alias("next")).toPandas()
    want = skewed.sort_values(["key", "pos"]).copy()
    want["seen"] = want.groupby("key")["maybe"].ffill()
    want["prev"] = want.groupby("key")["v"].shift(1)
    want["next"] = want.groupby("key")["v"].shift(-1)
    same(got, want[["key", "pos", "seen", "prev", "next"]], ["key", "pos"])


def test_blocks_bound_each_task_group(spark, skewed, split_groups):
    placed = SC.lanes(frame(spark, skewed), ["key"], ["pos"])
    assert placed.blocked
    sizes = placed.df.groupBy(SC.BLOCK, "key").count().toPandas()["count"]
    assert sizes.max() < 200 and placed.df.filter("key = 'hot'").select(SC.BLOCK).distinct().count() > 5


def test_carried_state_has_one_row_per_block(spark, skewed, split_groups):
    placed = SC.lanes(frame(spark, skewed), ["key"], ["pos"])
    carried = SC._carry(placed.df, placed, F.sum("v"), lambda own, w: F.sum(own).over(w))
    assert carried.groupBy("_cblock").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("split", [False, True])
def test_percentiles(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed)
    near = percentile_nearest(df, ["key"], "v", [5, 50, 95]).toPandas().set_index("key")
    ceil = percentile_ceil(df, ["key"], "v", {"c": 0.95}).toPandas().set_index("key")
    line = percentile_linear(df, ["key"], "v", {"q": 0.05}).toPandas().set_index("key")
    for key, group in skewed.groupby("key"):
        values = sorted(group["v"])
        n = len(values)
        for p in (5, 50, 95):
            assert near.loc[key, f"p{p}"] == values[max(1, -(-n * p // 100)) - 1]
        assert ceil.loc[key, "c"] == values[-(-(n - 1) * 95 // 100)]
        assert line.loc[key, "q"] == pytest.approx(group["v"].quantile(0.05))


@pytest.mark.parametrize("split", [False, True])
def test_asof_keeps_stored_nulls(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed)
    left, right = df.filter("pos % 2 = 0"), df.filter("pos % 2 = 1").withColumnRenamed("pos", "at")
    out = asof_join(left.select("key", "pos"), right, ["key"], "pos", "at", ["maybe", "at"])
    got = out.select("key", "pos", F.col("asof.at").alias("at"), F.col("asof.maybe").alias("maybe")).toPandas()
    lefts = skewed[skewed.pos % 2 == 0][["key", "pos"]].sort_values("pos")
    rights = skewed[skewed.pos % 2 == 1].rename(columns={"pos": "at"})[["key", "at", "maybe"]].sort_values("at")
    want = pd.merge_asof(lefts, rights, left_on="pos", right_on="at", by="key")
    same(got, want[["key", "pos", "at", "maybe"]], ["key", "pos"])


@pytest.mark.parametrize("split", [False, True])
def test_overlapping_ranges_go_to_the_earliest_start(spark, split, request):
    if split:
        request.getfixturevalue("split_groups")
    rng = random.Random(3)
    ranges = [("a", s, s + rng.randrange(12), s) for s in sorted(rng.sample(range(200), 60))]
    rows = [("a", i) for i in range(220)]
    left = spark.createDataFrame(rows, "k string, at bigint")
    right = spark.createDataFrame(ranges, "k string, f bigint, l bigint, name bigint")
    got = {r["at"]: r["name"] for r in interval_join(left, right, ["k"], "at", "f", "l", ["name"]).select("at", "hit.name").collect()}
    for _, at in rows:
        hits = [name for _, f, last, name in ranges if f <= at <= last]
        assert got[at] == (min(hits) if hits else None)
    cut = sorted((r["f"], r["l"]) for r in disjoint_ranges(right, ["k"], "f", "l").collect())
    assert all(a[1] < b[0] for a, b in zip(cut, cut[1:], strict=False))


@pytest.mark.parametrize("split", [False, True])
def test_change_ranges_and_gaps(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed).withColumn("level", F.col("v") % 2)
    got = change_ranges(df, ["key"], "pos", "level", tie="v").toPandas()
    want = []
    for key, group in skewed.sort_values("pos").groupby("key"):
        runs = []
        for row in group.itertuples():
            if runs and runs[-1][2] == row.v % 2:
                runs[-1][1], runs[-1][3] = row.pos, runs[-1][3] + 1
            else:
                runs.append([row.pos, row.pos, row.v % 2, 1])
        for i, run in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else run[1]
            want.append((key, run[0], max(last, run[0]), run[2], run[3]))
    same(got, pd.DataFrame(want, columns=["key", "first", "last", "level", "n"]), ["key", "first"])
    gaps = check_order(df.withColumnsRenamed({"key": "ledger_index", "pos": "transaction_index"})).toPandas()
    brute = sum(
        found != want
        for _, g in skewed.groupby("key")
        for want, found in zip([0, *[p + 1 for p in sorted(g.pos)]], sorted(g.pos), strict=False)
    )
    assert len(gaps) == brute


@pytest.mark.parametrize("split", [False, True])
def test_allocation_never_exceeds_funds(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed).withColumn("funds", F.lit(20_000)).withColumnRenamed("v", "size")
    got = allocate_funds(df, ["key"], ["size", "pos"]).select("key", "pos", "allocated").toPandas()
    want = []
    for key, group in skewed.groupby("key"):
        left = 20_000
        for row in group.sort_values(["v", "pos"]).itertuples():
            give = min(row.v, left)
            left -= give
            want.append((key, row.pos, give))
    same(got, pd.DataFrame(want, columns=["key", "pos", "allocated"]), ["key", "pos"])
    assert got.groupby("key")["allocated"].sum().max() <= 20_000


@pytest.mark.parametrize("split", [False, True])
def test_ladder_and_amount_only_range(spark, skewed, split, request):
    if split:
        request.getfixturevalue("split_groups")
    df = frame(spark, skewed)
    ladder = depth_ladder(df, ["key"], ["v", "pos"], "v", total=F.lit(5000)).toPandas()
    assert (ladder["before"] < 5000).all()
    hot = ladder[ladder.key == "hot"].sort_values("before")
    assert (hot["before"].iloc[1:].values == hot["after"].iloc[:-1].values).all()
    expected = df.groupBy("key").agg(F.lit(5).alias("expected_count"))
    out = amount_only_range(df.withColumn("tx_hash", F.col("pos").cast("string")), ["key"], "v", expected).toPandas().set_index("key")
    for key, group in skewed.groupby("key"):
        chosen = sorted(group["v"])[:5]
        assert out.loc[key, "complete"] == (len(group) >= 5)
        assert (out.loc[key, "min_err"], out.loc[key, "max_err"]) == (chosen[0], chosen[-1])
        assert out.loc[key, "median_err"] == pd.Series(chosen).median()


def test_asof_ties_keep_their_type(spark):
    right = spark.createDataFrame([("a", 1, 9), ("a", 1, 10)], "key string, at int, id int")
    out = asof_join(spark.createDataFrame([("a", 5)], "key string, pos int"), right, ["key"], "pos", "at", ["id"], tie="id")
    assert out.first()["asof"]["id"] == 10


def test_percentiles_of_a_null_group(spark):
    from marketflow.operators.percentiles import percentile_nearest

    rows = spark.createDataFrame([(None, 1), (None, 3), ("a", 5)], "g string, v int")
    assert {r["g"]: r["p50"] for r in percentile_nearest(rows, ["g"], "v", [50]).collect()} == {None: 1, "a": 5}
