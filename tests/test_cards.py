"""Raw card tables: canonical form, strictness, splits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.schemas import RAW_HEADERS, TXN_SCHEMA
from tidewatch.sources import cards

HEADER = list(RAW_HEADERS.values())


def write_cards(path, rows=None):
    rows = rows or [
        ["alice", "1", "2023", "1", str(day), "10:30", f"${100 + day}.00", "Chip Transaction", "merchant-a", "Austin",
         "TX", "78701", "5411", "", "Yes" if day in (5, 10) else "No"] for day in range(1, 11)]
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(",".join(HEADER) + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")
    return str(path)


def test_canonical_columns_and_values(spark, tmp_path):
    out = cards.canonical(cards.read_raw(spark, write_cards(tmp_path / "cards.csv")))
    assert out.columns == TXN_SCHEMA.names
    rows = out.orderBy("event_time").collect()
    assert rows[0]["amount"] == 101.0 and rows[0]["card_id"] == "alice::1"
    assert sum(r["is_fraud"] for r in rows) == 2
    assert [r["transaction_id"] for r in rows] == [str(i) for i in range(10)]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a", "b")], "User string, Card string")
    with pytest.raises(ValueError, match="Amount, Day, Errors\\?"):
        cards.canonical(df)


def test_malformed_line_fails_the_read(spark, tmp_path):
    path = tmp_path / "bad.csv"
    write_cards(path)
    with open(path, "a", encoding="utf-8") as fh:
        fh.write("only,three,fields\n")
    with pytest.raises(Exception):
        cards.read_raw(spark, str(path)).collect()


def test_unparseable_money_and_time_fail(spark, tmp_path):
    row = ["a", "1", "2023", "13", "1", "10:30", "$1.00", "x", "m", "c", "s", "z", "1", "", "No"]
    df = cards.read_raw(spark, write_cards(tmp_path / "t.csv", [row]))
    with pytest.raises(Exception):
        cards.canonical(df).collect()


def test_label_is_never_guessed(spark):
    df = spark.createDataFrame([(" YES ",), ("no",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(cards.label("v")).collect()] == [1, 0, None, None]


def test_splits_do_not_overlap_in_time(spark, tmp_path):
    txn = cards.canonical(cards.read_raw(spark, write_cards(tmp_path / "cards.csv")))
    out = str(tmp_path / "splits")
    cards.write_splits(txn, out)
    r = {x["split"]: x for x in cards.split_summary(spark.read.parquet(out)).collect()}
    assert r["train"]["max_us"] < r["validation"]["min_us"] <= r["validation"]["max_us"] < r["test"]["min_us"]
    assert sum(x["rows"] for x in r.values()) == 10


def test_equal_bounds_are_refused(spark):
    same = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1)) for i in range(5)], "transaction_id string, event_time timestamp")
    with pytest.raises(Exception, match="strictly ordered"):
        cards.check_bounds(cards.split_bounds(same)).collect()


def test_file_row_ids_are_contiguous(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "r"))
    ids = [r[0] for r in cards.with_file_row_id(spark.read.parquet(str(tmp_path / "r"))).select("row_id").collect()]
    assert sorted(ids) == list(range(1000))


def test_profile_counts_nulls(spark, tmp_path):
    p = {r["column"]: r for r in cards.profile(cards.read_raw(spark, write_cards(tmp_path / "c.csv"))).collect()}
    assert p["Errors?"]["nulls"] == 10 and p["User"]["nulls"] == 0 and p["Day"]["rows"] == 10
    assert not cards.missing_columns(cards.read_raw(spark, str(tmp_path / "c.csv")).select(*[F.col(f"`{c}`") for c in HEADER]))
