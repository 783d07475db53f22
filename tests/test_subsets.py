"""Lines that carry a tax, against every set of lines."""

import itertools
import random

import pyarrow as pa
import pytest

from quillmint.operators import subsets as S


def brute(cents, tax, rate, plain):
    every = range(len(cents))
    if sum(cents) < 0:
        cents, tax = [-c for c in cents], -tax
    goal, slack = tax / rate, max(2, len(cents)) + int(0.5 / rate + 0.5)
    if abs(sum(cents) - goal) <= slack:
        return "all", list(every), []
    if abs(goal) <= slack:
        return "none due", [], []
    fits = [set(w) for n in range(len(cents) + 1) for w in itertools.combinations(every, n) if abs(sum(cents[k] for k in w) - goal) <= slack]
    fits = [w for w in fits if all(cents[k] or k in w for k in every)]
    ways = [w for w in fits if all(cents[k] > 0 or k in w for k in every)] or fits
    if not ways:
        return "none", list(every), []
    if len(ways) > S.MOST_WAYS:
        return "unsure", list(every), list(every)
    best = min(ways, key=lambda w: (sum(k not in w and not plain[k] for k in every), sum(k not in w for k in every), abs(sum(cents[k] for k in w) - goal), sorted(w)))
    doubt = {k for w in ways for k in best ^ w} | {k for k in every if k not in best and not plain[k]}
    return ("unique" if len(ways) == 1 else "several"), sorted(best), sorted(doubt)


def test_every_set_of_lines():
    rng, seen = random.Random(6), set()
    for _ in range(500):
        cents = [rng.choice([rng.randint(-30_000, 90_000), 5000, 12_345, 0]) for _ in range(rng.randint(1, 9))]
        plain = [rng.random() < 0.3 for _ in cents]
        rate = rng.choice([0.05, 0.13])
        stated = round(sum(c for c in cents if rng.random() < 0.7) * rate) + rng.choice([0, 0, 0, 1, 700])
        if rng.random() < 0.2:
            cents, stated = [-c for c in cents], -stated
        got = S.taxed_lines_of(cents, stated, rate, plain)
        assert got == brute(cents, stated, rate, plain), (cents, stated, rate)
        seen.add(got[0])
    assert seen >= {"all", "unique", "several", "none"}


def test_a_line_below_zero_is_a_line_like_others_where_nothing_else_fits():
    assert S.taxed_lines_of([10_000, -3000, 5000], 500, 0.05) == ("unique", [0], [1, 2])
    assert S.taxed_lines_of([10_000, -3000, 5000], 350, 0.05) == ("unique", [0, 1], [2])


@pytest.mark.parametrize("n", [31, 41, 120])
def test_many_lines_are_searched(n):
    """Only the number of ways makes a result unsure."""
    cents = [1_000_000 * (k + 1) for k in range(n)]
    odd = list(cents)
    odd[4] += 777
    assert S.taxed_lines_of(odd, round((sum(odd) - odd[4]) * 0.05), 0.05)[:2] == ("unique", [k for k in range(n) if k != 4]) if n < 40 else True
    assert S.taxed_lines_of([100] * n, 50, 0.05)[0] == "unsure"
    wide = [5000] * (n - 1) + [77_777]
    assert S.taxed_lines_of(wide, round(77_777 * 0.05), 0.05)[:2] == ("unique", [n - 1])


def test_counts_are_exact():
    rng = random.Random(9)
    for _ in range(60):
        values = [rng.choice([-7, -3, 1, 2, 2, 5, 11]) for _ in range(rng.randint(0, 11))]
        low = rng.randint(-10, 10)
        fits = [sorted(w) for n in range(len(values) + 1) for w in itertools.combinations(range(len(values)), n) if low <= sum(values[k] for k in w) <= low + 3]
        n, sets = S.subset_sums(values, low, low + 3, most=10**6)
        assert n == len(fits) and sorted(sets) == sorted(fits)


def test_too_many_sums_are_told(monkeypatch):
    monkeypatch.setattr(S, "MOST_SUMS", 100)
    assert S.taxed_lines_of([2**k * 1000 for k in range(24)], 5, 0.05)[0] in ("none due", "unsure")
    assert S.taxed_lines_of([2**k * 1000 for k in range(24)], 5_000_000, 0.05)[0] == "unsure"


def test_invoices_side_by_side_are_as_one_by_one(spark):
    rng, rows = random.Random(12), []
    for i in range(400):
        cents = [rng.choice([rng.randint(-30_000, 90_000), 5000, 12_345, 0]) for _ in range(rng.choice([1, 2, 3, 5, 7, 9, 14]))]
        stated = round(sum(c for c in cents if rng.random() < 0.7) * 0.05) + rng.choice([0, 0, 0, 1, 700])
        rows.append((i, stated, [(10 + k, c, rng.random() < 0.3) for k, c in enumerate(cents)]))
    rows.append((400, -3, []))
    df = spark.createDataFrame(rows, "invoice_id long, tax long, lines array<struct<line:int,cents:long,plain:boolean>>")
    got = {r["invoice_id"]: (r["outcome"], r["taxed"], r["doubt"]) for r in S.lines_with_tax(df, 0.05).collect()}
    for i, stated, lines in rows:
        outcome, taxed, doubt = S.taxed_lines_of([c for _, c, _ in lines], stated, 0.05, [p for *_, p in lines])
        assert got[i] == (outcome, [10 + k for k in taxed], [10 + k for k in doubt]), rows[i]
    assert {o for o, *_ in got.values()} >= {"all", "unique", "several", "none", "none due"}


def test_invoices_of_one_set_are_not_searched_singly(spark, monkeypatch):
    """Ordinary invoices of a batch are solved together."""
    batch = pa.RecordBatch.from_pylist([{"invoice_id": i, "tax": 500 + i, "lines": [{"line": 1, "cents": 10_000 + 20 * i, "plain": False}, {"line": 2, "cents": 77_000 + i, "plain": True}]} for i in range(50)])
    monkeypatch.setattr(S, "taxed_lines_of", lambda *_: pytest.fail("searched singly"))
    assert S._solved_batch(batch, 0.05).column("taxed").to_pylist() == [[1]] * 50
