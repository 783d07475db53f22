"""Allocation of receipts to bills, piece by piece."""

import datetime as dt
import random

from quillmint.plans import orders as O

SCHEMA = "k string, id long, at date, quantity long"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def laid_out(rows):
    """The ids and dates of the single pieces of a key, in order."""
    return [(i, at) for at, i, q in sorted((at, i, q) for _, i, at, q in rows) for _ in range(q)]


def test_pieces_meet_in_order(spark):
    rng = random.Random(5)
    taken, given = ([(rng.choice("abc"), i, day(rng.randrange(20)), rng.randint(1, 9)) for i in range(n)] for n in (40, 33))
    taken.append(("only bills", 90, day(1), 4))
    given.append(("only receipts", 91, day(1), 4))
    got = {}
    for r in O.allocated(*(spark.createDataFrame(x, SCHEMA).repartition(3) for x in (taken, given)), ["k"]).collect():
        k = (r["k"], r["taken_id"], r["taken_at"], r["given_id"], r["given_at"])
        got[k] = got.get(k, 0) + r["quantity"]
    want = {}
    for key in {r[0] for r in taken + given}:
        a, b = (laid_out([r for r in rows if r[0] == key]) for rows in (taken, given))
        for n in range(max(len(a), len(b))):
            (ti, ta), (gi, ga) = a[n] if n < len(a) else (None, None), b[n] if n < len(b) else (None, None)
            want[key, ti, ta, gi, ga] = want.get((key, ti, ta, gi, ga), 0) + 1
    assert got == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("a", 1, day(0), 3)], SCHEMA)
    assert O.allocated(none, none, ["k"]).count() == 0
    assert [(r["taken_id"], r["given_id"], r["quantity"]) for r in O.allocated(one, none, ["k"]).collect()] == [(1, None, 3)]
