"""State carried across ranges, and breaches of separated duties against the trail read case by case."""

import random

from pyspark.sql import functions as F

from quillmint.operators.carry import filled, runs
from quillmint.plans.duties import conflicts, published_rates, rate_calendar


def test_filled_equals_one_pass(spark):
    rnd = random.Random(4)
    rows = [(rnd.choices(["hot", "a", "b", None], [8, 1, 1, 1])[0], n, rnd.choice([None, None, None, n]), rnd.choice([None] * 40 + [str(n)])) for n in range(3000)]
    frame = spark.createDataFrame(rows, "key string, n long, x long, y string").repartition(7)
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {(r["key"], r["n"]): (r["x"], r["y"]) for r in filled(frame, ["key"], ["n"], ["x", "y"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        last, want = {}, {}
        for key, n, x, y in rows:
            a, b = last.get(key, (None, None))
            last[key] = want[key, n] = (x if x is not None else a, y if y is not None else b)
        assert got == want
    assert filled(frame.limit(0), ["key"], ["n"], ["x"]).count() == 0


def test_runs_equal_one_pass(spark):
    rnd = random.Random(9)
    rows = [(rnd.choices(["hot", "a", None], [8, 1, 1])[0], n, rnd.choice([None, *[rnd.randrange(20000) / 10] * 9])) for n in range(3000)]
    want = {}
    for key in ("hot", "a", None):
        last = start = None
        for value, n in sorted((v, n) for k, n, v in rows if k == key and v is not None):
            start = value if last is None or value - last > 0.55 else start
            want[n], last = start, value
    frame = spark.createDataFrame(rows, "key string, n long, value double").repartition(7)
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert {r["n"]: r["run"] for r in runs(frame, ["key"], "value", 0.55, "run").collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_hand(rows, limit):
    cases, out = {}, set()
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        cases.setdefault(r[:2], []).append(r)
    rates = {}
    for r in rows:
        if r[5] == "exported" and r[6] != "CAD":
            rates[r[6], r[1]] = rates.get((r[6], r[1]), 0) + r[7]
    for case, steps in cases.items():
        done, refused, approvers, home = {}, None, set(), []
        for _, day, _, event, person, step, currency, cents in steps:
            if step in ("refused", "entered"):
                refused = event if step == "refused" else None
            if person is None:
                continue
            if step != "refused":
                done.setdefault(person, set()).add(step)
            if step in ("approved", "final"):
                if refused is not None:
                    out.add((case, person, "override"))
                approvers.add(person)
                known = [d for c, d in rates if c == currency and d <= day]
                home.append(cents if currency == "CAD" else (cents * (5000 + rates[currency, max(known)] % 10000) + 5000) // 10000 if known else None)
        out |= {(case, p, "several_steps") for p, s in done.items() if len(s) > 1}
        out |= {(case, p, "own_entry") for p, s in done.items() if "entered" in s and s & {"approved", "final"}}
        if len(approvers) == 1 and (None in home or max(home) > limit):
            out.add((case, approvers.pop(), "alone_over_limit"))
    return out


def test_conflicts_equal_reading_case_by_case(spark):
    import datetime as dt

    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for n in range(400):
        at = start + dt.timedelta(hours=rnd.randrange(24 * 6))
        k = rnd.choices(range(6), [20, 1, 3, 3, 3, 3])[0]
        rows.append((k, at.date(), at, n, rnd.choice([1, 2, 3, 4, None]), rnd.choice(["entered", "approved", "final", "exported", "refused"]), ("CAD", "USD", "EUR")[k % 3], rnd.randrange(40000)))
    steps = spark.createDataFrame(rows, "k int, day date, happened timestamp_ntz, event_id long, person long, step string, currency string, cents long")
    calendar = rate_calendar(published_rates(steps), steps.groupBy("currency").agg(F.max("day").alias("last_day")))
    got = [((r["k"], r["day"]), r["person"], r["pattern"]) for r in conflicts(steps, calendar, 20_000).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(rows, 20_000)
    assert {p for *_, p in got} == {"several_steps", "own_entry", "override", "alone_over_limit"}
    assert conflicts(steps.limit(0), calendar, 1).count() == 0
