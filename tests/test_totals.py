"""The totals solver against trying every choice of readings."""

import itertools
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quillmint.operators import totals as S
from quillmint.operators.totals import Read, solve_totals


def brute(fields, rates, lines_sum):
    best = None
    taxed = any(fields[3:])
    for chosen in itertools.product(*[range(len(f) + 1) for f in fields]):
        reads = [f[n] if n < len(f) else None for f, n in zip(fields, chosen)]
        sub, total, charge, *taxes = reads
        places = [t.place for t in taxes if t]
        if sub and total and sub.place == total.place or len(set(places)) < len(places):
            continue
        extra, paid = charge.value if charge else 0, [t for t in taxes if t]
        score, fits = sum(r.score for r in reads if r), False
        if sub and total:
            fits = abs(sub.value + extra + sum(t.value for t in paid) - total.value) <= 1
            if fits and paid:
                score += 3000 + 500 * len(paid)
            elif fits and not taxed:
                score += 2500
            elif not fits and paid and abs(sub.value - total.value) <= 1:
                score -= 1000
        if sub and lines_sum is not None and abs(sub.value - lines_sum) <= 1:
            score += 1000
        if sub and sub.value:
            for t, rate in zip(taxes, rates):
                if t and any(abs(t.value - rate / 100_000 * b) <= max(2, 0.01 * abs(t.value)) + 1e-9 for b in (sub.value, sub.value + extra)):
                    score += 300
        if best is None or score > best[0]:
            best = (score, tuple(n if n < len(f) else None for f, n in zip(fields, chosen)), fits and (bool(paid) or not taxed))
    return best


def made_up(rng):
    sub, charge = rng.randint(-5000, 90_000), rng.choice([0, 0, 500])
    taxes = [round(sub * r / 100_000) for r in (5000, 13_000, 9975)]
    values = [sub, sub + charge + sum(taxes), charge, *taxes]
    fields = []
    for v in values:
        reads = [v] * rng.choice([0, 1, 1, 1]) + [rng.choice([v + 1, v + 900, rng.choice(values), sub]) for _ in range(rng.randint(0, 2))]
        rng.shuffle(reads)
        fields.append([Read(x, rng.choice([-50, 200, 500, 500, 900]), rng.randint(0, 12)) for x in reads])
    return fields[: rng.randint(3, 6)], rng.choice([None, sub, sub + 1, 77])


def test_every_choice():
    rng, seen = random.Random(2), set()
    for _ in range(400):
        fields, lines_sum = made_up(rng)
        rates = [5000, 13_000, 9975][: len(fields) - 3]
        got = solve_totals(fields, rates, lines_sum)
        if not any(fields):
            assert got.outcome == "nothing read"
            continue
        score, chosen, sure = brute(fields, rates, lines_sum)
        assert (got.score, got.chosen, got.outcome == "adds up") == (score, chosen, sure)
        seen.add(got.outcome)
    assert seen == {"adds up", "likeliest"}


def test_most_choices_are_never_completed():
    """Eight fields of six readings are 5.7 million choices."""
    rng = random.Random(3)
    true = [100_000, 100_000 + 5000 + 8000 + 2500 + 700 + 60, 60, 5000, 8000, 2500, 700, 0]
    fields = [[Read(v, 800, k)] + [Read(v + rng.randint(100, 9000), 400, 100 * k + n) for n in range(5)] for k, v in enumerate(true)]
    got = solve_totals(fields, [5000, 8000, 2500, 700, 1], 100_000)
    assert got.outcome == "adds up" and got.chosen[:7] == (0,) * 7 and got.steps < 2000


def test_a_search_that_ends_early_is_unsolved():
    fields = [[Read(k, 500, 10 * f + k) for k in range(1, 7)] for f in range(6)]
    assert solve_totals(fields, [1, 1, 1], None, most_steps=5) == ("unsolved", 0, (None,) * 6, 5)


def test_rows_without_readings(spark):
    kind = "invoice_id long, lines_sum long, reads array<struct<field string, value long, score int, place int>>"
    rows = [(1, None, []), (2, 500, None), (3, 500, [("subtotal", 500, 300, 1), ("stray", 9, 900, 2), ("total", 525, 300, 3), ("gst", 25, 300, 4)])]
    got = {r["invoice_id"]: tuple(r)[1:] for r in S.totals_of(spark.createDataFrame(rows, kind), {"gst": 5000}).collect()}
    assert got[1] == got[2] == ("nothing read", 0, None, None, None, None)
    assert got[3] == ("adds up", 900 + 3500 + 1000 + 300, 500, 525, None, 25)
    assert S.totals_of(spark.createDataFrame([], kind), {}).agg(F.count("*")).first()[0] == 0


def test_few_choices_are_scored_side_by_side(monkeypatch):
    """Batches give what one search an invoice gives, without a search where choices are few."""
    rng, names = random.Random(5), ["subtotal", "total", "charge", "gst", "hst", "qst"]
    rates, rows = [5000, 13_000, 9975], []
    for i in range(600):
        fields, lines_sum = made_up(rng)
        fields += [[]] * (6 - len(fields))
        rows.append((i, lines_sum, fields))
    want = [solve_totals(f, rates, s) for _, s, f in rows]
    values = [[None if n is None else own[n].value for n, own in zip(w.chosen, f)] for w, (_, _, f) in zip(want, rows)]
    reads = [[{"field": n, **r._asdict()} for n, f in zip(names, fields) for r in f] for _, _, fields in rows]
    kind = pa.list_(pa.struct([("field", pa.string()), ("value", pa.int64()), ("score", pa.int32()), ("place", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([s for _, s, _ in rows], pa.int64()), pa.array(reads, kind)], names=["invoice_id", "lines_sum", "reads"])
    searched = S._solved_batch(batch, names, rates, 10).to_pydict()
    assert searched["outcome"] == [solve_totals(f, rates, s, 10).outcome for _, s, f in rows]
    monkeypatch.setattr(S, "solve_totals", None)
    got = S._solved_batch(batch, names, rates, S.MOST_STEPS).to_pydict()
    assert got["outcome"] == [w.outcome for w in want] and got["score"] == [w.score for w in want]
    assert [list(x) for x in zip(*(got[n] for n in names))] == values
