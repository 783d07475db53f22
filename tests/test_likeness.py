"""The similarity join against comparing all lines, and the ratio of common blocks."""

import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmint.operators import likeness as L

SCHEMA = "id long, words array<struct<word string, weight long>>"


def lines(n=220):
    rng = random.Random(12)
    stems = ["".join(rng.choice("abcdefgo") for _ in range(rng.randint(3, 9))) for _ in range(60)] + ["bracket", "brackets", "maintenance", "maintenence", "con", "consult", "cat5", "cat6"]

    def spelt(w):
        if rng.random() < 0.15 and len(w) > 5:
            k = rng.randrange(len(w) - 1)
            return rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + "z" + w[k:], w[: rng.randint(3, len(w))]])
        return w

    weight = {}
    out = []
    for k in range(n):
        words = {spelt(rng.choice(stems[: 6 if rng.random() < 0.3 else len(stems)])) for _ in range(rng.randint(0, 6))}
        out.append((k, [(w, weight.setdefault(w, rng.choice([1, 7, 630, 5040]))) for w in sorted(words)]))
    return out


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_pairs_are_those_of_all_comparisons(spark, least):
    rows = lines()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in L.similar_pairs(docs, least).collect())
    con = duckdb.connect()
    con.execute("create table l (id bigint, words struct(word varchar, weight bigint)[])")
    con.executemany("insert into l values (?, ?)", [(i, [{"word": w, "weight": x} for w, x in ws]) for i, ws in rows])
    want = sorted(con.execute("select a, b, common, together, similarity from " + L.similar_pairs_sql("select * from l", least)).fetchall())
    assert [x[:4] for x in got] == [x[:4] for x in want] and len(got) > 10
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want])


def test_few_pairs_are_compared(spark):
    docs = spark.createDataFrame(lines(600), SCHEMA)
    tried = L.similar_pairs(docs, 0.8, measure=True).count()
    found = L.similar_pairs(docs, 0.8).count()
    assert found <= tried < 600 * 599 // 2 // 20


def test_odd_lines(spark):
    rows = [(1, []), (2, None), (3, [("one", 5)]), (4, [("one", 5)]), (None, [("one", 5)])]
    assert [tuple(r) for r in L.similar_pairs(spark.createDataFrame(rows, SCHEMA), 0.5).collect()] == [(3, 4, 500, 500, 1.0)]
    assert L.similar_pairs(spark.createDataFrame([], SCHEMA), 0.5).count() == 0


def test_line_words(spark):
    texts = ["Safety gloves, the LARGE ones 12 pcs", "glass for 4x4", None, "a bc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.line_words(F.col("t"))).collect()]
    assert got == [["glove", "large", "ones", "pcs", "safety"], ["4x4", "glass"], None, []]


def test_block_ratio(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))) for _ in range(12)] + [None, "", "freight"]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.block_ratio("a", "b").alias("r")).collect()
    for r in got:
        assert r["r"] == SequenceMatcher(None, r["a"] or "", r["b"] or "", autojunk=False).ratio()
    assert L.block_ratio.func(pd.Series([], dtype=str), pd.Series([], dtype=str)).empty
