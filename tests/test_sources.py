"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from marketflow.sources import readers as R
from marketflow.sources import writers as W
from marketflow.sources.schemas import MissingColumns


def lines(path, rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_required_columns_and_hash_aliases(spark):
    swaps = spark.createDataFrame([("a", 1)], "transaction_hash string, ledger_index bigint")
    with pytest.raises(MissingColumns, match="transaction_index"):
        R.normalise_swaps(swaps)
    legs = spark.createDataFrame([(None, "b", 1, 2), ("a", None, 1, 2)], "tx_hash string, transaction_hash string, ledger_index bigint, transaction_index bigint")
    assert sorted(r["tx_hash"] for r in R.normalise_legs(legs).collect()) == ["a", "b"]
    with pytest.raises(MissingColumns, match="tx_hash"):
        R.normalise_legs(legs.drop("tx_hash", "transaction_hash"))


def test_delimiter_is_sniffed(spark, tmp_path):
    for sep in (",", "\t"):
        path = lines(tmp_path / f"t{ord(sep)}.csv", [sep.join(("tx_hash", "ledger_index")), sep.join(("x", "5"))])
        assert R.read_delimited(spark, path).collect()[0].asDict() == {"tx_hash": "x", "ledger_index": "5"}


def test_key_list_keeps_first_positions(spark, tmp_path):
    path = lines(tmp_path / "keys.txt", ["# head", " b ", "a", "", "B", "c", "a"])
    assert [r["tx_hash"] for r in R.read_key_list(spark, path).collect()] == ["B", "A", "C"]
    assert [r["tx_hash"] for r in R.read_key_list(spark, path, limit=2).collect()] == ["B", "A"]
    csv = lines(tmp_path / "keys.csv", ["n,transaction_hash", "1,q", "2,Q", "3,r"])
    assert [r["tx_hash"] for r in R.read_key_list(spark, csv).collect()] == ["Q", "R"]


def test_ledger_list(spark, tmp_path):
    path = lines(tmp_path / "l.txt", ["7", "3", "", "7", "x"])
    assert [r[0] for r in R.read_ledger_list(spark, path).collect()] == [3, 7]


def test_tick_sizes_keep_null_values(spark, tmp_path):
    (tmp_path / "ticks_at_10.json").write_text(json.dumps({"tick_sizes": {"A": 5, "B": None}}))
    (tmp_path / "ticks_at_12.json").write_text(json.dumps({"A": None, "C": 6}))
    got = {(r["ledger_index"], r["account"]): r["tick_size"] for r in R.read_tick_sizes(spark, str(tmp_path)).collect()}
    assert got == {(10, "A"): 5, (10, "B"): None, (12, "A"): None, (12, "C"): 6}
    (tmp_path / "ticks_at_13.json").write_text("{broken")
    with pytest.raises(Exception, match="unreadable tick sizes"):
        R.read_tick_sizes(spark, str(tmp_path)).collect()


def test_pair_configuration(spark, tmp_path):
    config = {"ledger_start": 1, "ledger_end": 9, "counter_currency": "XRP", "pairs": [{"pair": "p", "pair_label": "TOK/XRP", "base_label": "TOK", "base_currency": "TOK", "base_issuer": "I"}, {"pair": "q", "base_label": "Q", "ledger_start": 4}]}
    (tmp_path / "pairs.json").write_text(json.dumps(config, indent=1))
    got = {r["pair"]: r for r in R.read_pairs(spark, str(tmp_path / "pairs.json")).collect()}
    assert (got["p"]["pair_key"], got["p"]["window"], got["p"]["counter_issuer"]) == ("TOK_XRP", "ledger_1_9", "")
    assert (got["q"]["ledger_start"], got["q"]["window"], got["q"]["counter_currency"]) == (4, "ledger_4_9", "XRP")


def test_bad_metadata_lines(spark, tmp_path):
    good = json.dumps({"tx_hash": "a", "result": {"hash": "a", "TakerGets": {"currency": "T", "issuer": "I", "value": "1"}, "TakerPays": "5"}})
    path = lines(tmp_path / "m.ndjson", [good, "", "{broken"])
    rows = R.read_metadata(spark, path, on_bad="quarantine")
    ok, bad = W.split_bad(rows, {"malformed": F.col(R.CORRUPT).isNull()})
    assert (ok.count(), [r["reject_reason"] for r in bad.collect()]) == (1, ["malformed"])
    row = ok.first()["result"]
    assert json.loads(row["TakerGets"])["value"] == "1" and row["TakerPays"] == "5"
    with pytest.raises(Exception, match="MALFORMED_RECORD|Malformed"):
        R.read_metadata(spark, path).collect()


def test_results_folders_name_the_pair(spark, tmp_path):
    for pair in ("A_XRP", "B_XRP"):
        (tmp_path / pair).mkdir()
        lines(tmp_path / pair / "results.ndjson", [json.dumps({"tx_hash": "t", "found_improvement": True, "best": {"improvement_bps": "1.5"}})])
    got = R.read_results(spark, str(tmp_path)).select("pair", "best.improvement_bps").collect()
    assert sorted((r[0], r[1]) for r in got) == [("A_XRP", "1.5"), ("B_XRP", "1.5")]


def test_single_csv_file(spark, tmp_path):
    W.write_csv(spark.range(5), str(tmp_path / "c"), single_file=True)
    assert len(list((tmp_path / "c").glob("part-*"))) == 1


def test_sorted_table_puts_nulls_last(spark, tmp_path):
    W.write_table(spark.createDataFrame([(None,), (2,), (1,)], "a int"), str(tmp_path / "t"), sort=["a"])
    files = sorted((tmp_path / "t").glob("part-*"))
    values = [r["a"] for f in files for r in spark.read.parquet(str(f)).collect()]
    assert values == [1, 2, None]


def test_manifest_in_one_pass(spark, tmp_path):
    got = W.write_manifest(spark.range(10), str(tmp_path / "m"), metrics={"rows": F.count(F.lit(1)), "top": F.max("id")}, facts={"pair": "p"})
    assert got == {"pair": "p", "rows": 10, "top": 9}
    assert spark.read.json(str(tmp_path / "m_manifest")).first().asDict() == {"pair": "p", "rows": 10, "top": 9}


def test_book_range_reads_only_its_buckets(spark, tmp_path):
    rows = [(n * 4000, "h", "gets_native") for n in range(20)]
    W.write_book(spark.createDataFrame(rows, "ledger_index bigint, ledger_hash string, side string").withColumn("offers", F.array().cast("array<struct<index:string>>")), str(tmp_path / "b"))
    part = R.in_ledger_range(spark.read.parquet(str(tmp_path / "b")), 12_000, 28_000)
    assert sorted(r["ledger_index"] for r in part.collect()) == [12_000, 16_000, 20_000, 24_000, 28_000]
    assert "PartitionFilters: [isnotnull(ledger_bucket" in part._jdf.queryExecution().executedPlan().toString()


def test_book_range_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "book")
    rows = spark.range(0, 50_000, 500).select(F.col("id").alias("ledger_index"), F.lit("s").alias("side"), F.array(F.struct(F.lit("o").alias("index"))).alias("offers"))
    W.write_book(rows, path)

    def files_read(df):
        found = {r["ledger_index"] for r in df.collect()}
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return found, leaf.metrics().apply("numFiles").value()

    everything, all_files = files_read(R.read_book(spark, path, 0, 49_999))
    part, few_files = files_read(R.read_book(spark, path, 12_000, 18_000))
    assert everything == set(range(0, 50_000, 500)) and part == set(range(12_000, 18_001, 500))
    assert all_files >= 5 and few_files <= all_files - 4


def test_tick_sizes_in_ledger_folders(spark, tmp_path):
    sizes = spark.createDataFrame([(10, '{"A": 5}'), (11, '{"tick_sizes": {"A": null}}')], "ledger_index bigint, value string")
    sizes.write.partitionBy("ledger_index").text(str(tmp_path / "ticks"))
    assert sorted(tuple(r) for r in R.read_tick_sizes(spark, str(tmp_path / "ticks")).collect()) == [(10, "A", 5), (11, "A", None)]
    spark.createDataFrame([(12, "{broken")], "ledger_index bigint, value string").write.mode("append").partitionBy("ledger_index").text(str(tmp_path / "ticks"))
    with pytest.raises(Exception, match="unreadable tick sizes"):
        R.read_tick_sizes(spark, str(tmp_path / "ticks")).collect()


def test_single_file_output_is_one_file(spark, tmp_path):
    W.write_csv(spark.range(1000).repartition(5), str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "one").glob("part-*.csv"))) == 1 and R.read_delimited(spark, str(tmp_path / "one")).count() == 1000


def test_packed_tick_sizes_read_as_files_do_and_are_few(spark, tmp_path):
    maps = spark.range(300).selectExpr("id ledger_index", """if(id % 2 = 0, concat('{"tick_sizes":\n {"A": ', id % 9, ', "B": null}}'), '{"A\\\\t": 5}') value""").repartition(3)
    W.write_tick_sizes(maps, str(tmp_path / "packed"))
    maps.filter("ledger_index < 20").write.partitionBy("ledger_index").option("lineSep", "\x01").text(str(tmp_path / "single"))
    packed = R.read_packed_tick_sizes(spark, str(tmp_path / "packed"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert len(list((tmp_path / "packed").glob("part-*"))) == 3 and packed.count() == 450
    assert rows(packed.filter("ledger_index < 20"))[:2] == [(0, "A", 0), (0, "B", None)] and ("A\t") in {r["account"] for r in packed.collect()}
    for bad in ("12\t{broken", '{"A": 5}', 'x\t{"A": 5}'):
        lines(tmp_path / "bad.txt", [bad])
        with pytest.raises(Exception, match="unreadable tick sizes"):
            R.read_packed_tick_sizes(spark, str(tmp_path / "bad.txt")).collect()


def test_tick_size_scan_writes_no_file_per_ledger(spark, tmp_path, monkeypatch):
    from marketflow.plans.twins import base

    monkeypatch.setattr(base, "scratch", lambda spark: str(tmp_path / "ticks"))
    found = base.tick_size_scan(spark, "/root/testdata/sf0.001")
    assert found.select("ledger_index").distinct().count() > 50 and len(list((tmp_path / "ticks").rglob("part-*"))) <= 8
