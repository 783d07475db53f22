"""Expressions, filters, joins, feeds and streams on small values of their own."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmint.functions import dates as D
from quillmint.functions import keys as K
from quillmint.functions import money as M
from quillmint.functions import stats as S
from quillmint.operators import filters as Q
from quillmint.operators import joins as J
from quillmint.sources import feeds, files
from quillmint.streaming import maintain


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_keys(spark):
    assert values(spark, K.name_key, ["Café Métro, Inc.", "Smith & Sons Co. Ltd", "Inc", None]) == ["cafe metro", "smith and sons", "inc", None]
    assert values(spark, K.number_key, ["INV-00123", "000", "Facture 9", "A-0b", ""]) == ["123", "0", "9", "a0b", None]
    assert values(spark, K.masked, ["1234-5678", "12"]) == ["****5678", "12"]
    assert values(spark, K.safe_cell, ["=1+1", "-3.50", "-x", "+1,000", "ok"]) == ["'=1+1", "-3.50", "'-x", "+1,000", "ok"]
    assert values(spark, K.remark_shape, ["Rent JAN 2024", "rent february 25"]) == ["rent", "rent"]


def test_amounts_and_dates(spark):
    typed = ["1,250.00", "(12.50)", "1.250,75", "99 CR", "7-", "$ 3", "x", None]
    assert [None if v is None else float(v) for v in values(spark, D.parsed_amount, typed)] == [1250.0, -12.5, 1250.75, -99.0, -7.0, 3.0, None, None]
    assert values(spark, D.parsed_date, ["2024-02-29", "29/02/2024", "02/29/2024", "nope"]) == [dt.date(2024, 2, 29)] * 3 + [None]
    day = F.lit(dt.date(2024, 1, 31))
    due = values(spark, lambda x: D.due_dates(x, day)["due"], ["net 30", "2/10 net 45", "EOM+15", "due on receipt"])
    assert due == [dt.date(2024, 3, 1), dt.date(2024, 3, 16), dt.date(2024, 2, 15), dt.date(2024, 1, 31)]


def test_split_keeps_the_total(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 999)) for k in range(40) for i in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "k int, i int, w int").selectExpr("k", "i", "cast(w as decimal(18,2)) as w", "cast(k * 7.13 as decimal(18,2)) as total")
    shared = M.split_in_proportion(df, "k", "total", "w", "i", "share").groupBy("k").agg(F.sum("share").alias("s"), F.first("total").alias("t"))
    assert shared.where("s <> t").count() == 0


def test_wilson(spark):
    low = spark.range(1).select(S.wilson_low(F.lit(20), F.lit(20)), S.wilson_low(F.lit(0), F.lit(0))).first()
    assert low[0] == pytest.approx(0.8808, abs=1e-3) and low[1] == 0


def test_filters(spark):
    df = spark.createDataFrame([("Élan", 100.0, dt.date(2024, 3, 5), "a"), ("plain", None, dt.date(2025, 1, 1), "b"), (None, 250.0, None, None)], "t string, n double, d date, c string")
    kinds = {"t": "text", "n": "amount", "d": "date", "c": "choice"}
    count = lambda **typed: Q.by_example(df, typed, kinds)[0].count()
    assert (count(t="elan"), count(t="=PLAIN"), count(t="!empty"), count(t="empty"), count(t="?l*"), count(t="!elan")) == (1, 1, 2, 1, 2, 2)
    assert (count(n="250..50"), count(n=">100"), count(n="!0"), count(n="100")) == (2, 1, 2, 1)
    assert (count(d="2024-03"), count(d="2024..2025-01-01"), count(d="!2024"), count(d=">2024")) == (1, 2, 2, 1)
    assert (count(c="a, b"), count(c="!a")) == (2, 2)
    left, problems = Q.by_example(df, {"n": "lots", "c": "a"}, kinds)
    assert left.count() == 1 and list(problems) == ["n"]
    assert df.where(Q.glob(F.col("t"), "pl[a-c]?n")).count() == 1


def test_one_keystroke(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc1") for _ in range(rng.randint(3, 6))) for _ in range(120)]

    def near(a, b):
        if a == b:
            return False
        one = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc1"}
        one |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc1"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in one

    pairs = [(a, b) for a in words[:60] for b in words[60:]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("hit", J.one_keystroke(F.col("a"), F.col("b")))
    df = df.withColumn("shared", F.arrays_overlap(J.deletion_variants(F.col("a")), J.deletion_variants(F.col("b"))))
    for r in df.collect():
        assert r["hit"] == near(r["a"], r["b"]), r
        assert r["shared"] or not r["hit"]


def test_as_of(spark):
    facts = spark.createDataFrame([(1, "x", dt.date(2024, 5, 1)), (2, "x", dt.date(2020, 1, 1)), (3, "y", dt.date(2024, 1, 1))], "id int, k string, at date")
    rates = spark.createDataFrame([("x", dt.date(2024, 1, 1), None, 1), ("x", dt.date(2024, 4, 1), dt.date(2024, 6, 1), 2)], "k string, s date, e date, v int")
    got = {r["id"]: r["v"] for r in J.as_of(facts, rates, "k", "at", "s", "e", F.lit(0), "id").collect()}
    assert got == {1: 2, 2: None, 3: None}


def test_greedy_match_takes_each_once(spark):
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([("v", 1, day, 10.0), ("v", 2, day, 10.0), ("v", 3, day, -10.0)], "k string, id long, at date, amount double")
    b = spark.createDataFrame([("v", 7, day, 10.0), ("w", 8, day, 10.0)], "k string, id long, at date, amount double")
    assert {r[0]: r[1] for r in J.greedy_match(a, b, ["k"], 0.01).collect()} == {1: 7, 2: None, 3: None}


def test_feed_round_trip(spark, tmp_path):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    two = spark.createDataFrame([(2, "c"), (3, None)], "id int, v string")
    feeds.land(feeds.changes(one.limit(0), one, ["id"]), str(tmp_path / "z"), 1)
    feeds.land(feeds.changes(one, two, ["id"]), str(tmp_path / "z"), 2)
    assert sorted(map(tuple, feeds.landed(spark, str(tmp_path / "z"), ["id"]).collect())) == [(2, "c"), (3, None)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code;name\n01;Élan\n02;=x\n")
    df = files.sniffed_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["code", "name"] and df.count() == 2
    files.write_csv(df, str(tmp_path / "out"))
    assert {r["name"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"Élan", "'=x"}


def test_streams_equal_batch(spark, tmp_path):
    from tests.conftest import SF

    source = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(source)
    events = maintain.event_stream(spark, source)
    maintain.run_to(maintain.autonomy(events), str(tmp_path / "auto"), str(tmp_path / "c1"))
    n = spark.read.parquet(source).count()
    assert spark.read.parquet(str(tmp_path / "auto")).count() == n
    maintain.run_to(maintain.windowed_counts(events, late="0 seconds"), str(tmp_path / "win"), str(tmp_path / "c2"))
    batch = maintain.windowed_counts(spark.read.parquet(source).withColumn("at", F.col("ts").cast("timestamp")))
    stream = spark.read.parquet(str(tmp_path / "win"))
    last = stream.agg(F.max("end")).first()[0]
    assert stream.exceptAll(batch).count() == 0 and batch.where(F.col("end") <= F.lit(last)).exceptAll(stream).count() == 0
