"""Fused readings against their definition."""

import math
import random

import pytest

from quillmint.operators import fusion as U

SCHEMA = "k int, value long, family string, probability double"


def brute(rows, tolerance):
    rows = sorted(r for r in rows if r[0] is not None)
    classes = []
    for v, fam, p in rows:
        if not classes or v - classes[-1][-1][0] > tolerance:
            classes.append([])
        classes[-1].append((v, fam, p))
    scored = []
    for c in classes:
        best = {}
        for v, fam, p in c:
            best[fam] = max(best.get(fam, (-1, 0)), (p, -v))
        strength = round(1 - math.prod(1 - min(p, U.MOST_SURE) for p, _ in best.values()), 9)
        value = -max((min(p, U.MOST_SURE), v) for p, v in best.values())[1]
        scored.append((-strength, value, "+".join(sorted(best))))
    scored.sort()
    odds = [-s / (1 + s) for s, *_ in scored]
    share = scored[1][0] / scored[0][0] if len(scored) > 1 else 0.0
    return scored[0][1], odds[0] / (1 + sum(odds)), scored[0][2], scored[1][1] if len(scored) > 1 else None, share


def test_fused(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([100, 101, 102, 250, 251, -5, None]), rng.choice(["text", "image", "cloud"]), rng.choice([0.3, 0.55, 0.8, 0.999])) for k in range(60) for _ in range(rng.randint(1, 7))]
    got = {r["k"]: r for r in U.fused(spark.createDataFrame(rows, SCHEMA).repartition(3), ["k"], 1).collect()}
    for k in range(60):
        mine = [r[1:] for r in rows if r[0] == k]
        if all(v is None for v, *_ in mine):
            assert k not in got
            continue
        value, confidence, families, rival, share = brute(mine, 1)
        r = got[k]
        assert (r["value"], r["families"], r["rival"]) == (value, families, rival)
        assert (r["confidence"], r["rival_share"]) == pytest.approx((confidence, share), abs=2e-6)


def test_readers_of_one_family_count_once(spark):
    one, two, other = ([("text", 0.8)], [("text", 0.8), ("text", 0.7)], [("text", 0.8), ("image", 0.7)])
    rows = [(k, 500, f, p) for k, x in enumerate((one, two, other)) for f, p in x]
    got = {r["k"]: r["confidence"] for r in U.fused(spark.createDataFrame(rows, SCHEMA), ["k"], 1).collect()}
    assert got[0] == got[1] < got[2] == pytest.approx(0.94)


def test_checks_and_calibration(spark):
    rows = [(1, 5, 0.9, 0.0, 2, False, False), (2, 5, 0.9, 0.0, 0, False, False), (3, 5, 0.99, 0.0, 3, True, False), (4, 5, 0.9999, 0.0, 1, False, True), (5, None, None, None, 0, False, False), (6, 5, 0.95, 0.2, 3, False, False), (7, 5, 0.4, 1.0, 0, False, False)]
    df = spark.createDataFrame(rows, "k int, value long, confidence double, rival_share double, confirms int, failed boolean, soft boolean")
    got = {r["k"]: (r["status"], r["confidence"]) for r in U.judged(df).collect()}
    assert got == {1: ("likely", 0.975), 2: ("likely", 0.9), 3: ("check", 0.5), 4: ("likely", 0.97), 5: ("missing", 0.0), 6: ("verified", 0.99375), 7: ("check", 0.4)}
    past = spark.createDataFrame([(1, 8, 4)], "k int, cases long, right long")
    told = {r["k"]: r["calibrated"] for r in U.calibrated(U.judged(df), past, ["k"]).collect()}
    assert told[1] == pytest.approx((4 + 2 * 0.975) / 10) and told[2] == 0.9


def test_lists_of_readings(spark):
    """Readings that come with their row give what readings in rows of their own give, and no row moves."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(k, rng.choice([100, 101, 102, 103, 250, 251, -5, None]), rng.choice(["text", "image", "cloud", "a"]), rng.choice([0.3, 0.55, 0.8, 0.999])) for k in range(300) for _ in range(rng.randint(0, 8))]
    each = spark.createDataFrame(rows, SCHEMA)
    columns = ["value", "confidence", "families", "rival", "rival_share", "evidence"]
    want = {r["k"]: tuple(r[c] for c in columns) for r in U.fused(each, ["k"], 1).collect()}
    lists = spark.range(300).selectExpr("cast(id as int) as k").join(each.groupBy("k").agg(F.collect_list(F.struct("value", "family", "probability")).alias("x")), "k", "left").withColumn("y", F.slice("x", 1, 0))
    found = U.fused_lists(lists, ["x", "y"], 1)
    for r in found.collect():
        assert tuple(r["x"][c] for c in columns[:5]) == want.get(r["k"], (None,) * 5)[:5] or r["k"] not in want and r["x"]["value"] is None
        assert r["k"] not in want or r["x"]["evidence"] == want[r["k"]][5]
        assert r["y"]["value"] is None


def test_query_moves_items_and_orders_only(spark):
    from quillmint import registry

    plan = registry.queries()["confidence_fusion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan.split("Exchange hashpartitioning(invoice_id")[-1]
