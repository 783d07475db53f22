"""Payment terms: every printed form, over dates, and instalments to the cent."""

import datetime as dt

import pytest

from quillmint.functions.terms import with_terms

D = dt.date
# From 2026-09-10 and 100.00: terms, due, discounts (basis points, by).
FORMS = [
    ("Net 30", D(2026, 10, 10), []), ("N/45", D(2026, 10, 25), []), ("Payment terms: Net 30. Thank you", D(2026, 10, 10), []), ("Payable dans les 30 jours", D(2026, 10, 10), []),
    ("2/10 Net 30", D(2026, 10, 10), [(200, D(2026, 9, 20))]), ("1.5/15 n60", D(2026, 11, 9), [(150, D(2026, 9, 25))]), ("2% 10 net 30", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("1% 15 days, net 45", D(2026, 10, 25), [(100, D(2026, 9, 25))]), ("2 % escompte 10 jours, net 30 jours", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("Due on receipt", D(2026, 9, 10), []), ("Payable sur réception", D(2026, 9, 10), []), ("Net 30 due 10/31", D(2026, 10, 10), []),
    ("2/10 EOM", D(2026, 10, 30), [(200, D(2026, 10, 10))]), ("2/10 EOM net 45", D(2026, 11, 14), [(200, D(2026, 10, 10))]), ("Net 30, 2% 10", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("Net 30 - 1.5% per month on overdue", D(2026, 10, 10), []), ("1.5% interest per month after 30 days", D(2026, 10, 10), []), ("Overdue accounts are charged 2% interest per month", None, []),
    ("Net 30 days 1.5% 1 month interest", D(2026, 10, 10), []), ("Net 30, 2% 2 months", D(2026, 10, 10), []), ("Net 30, 1% 1 an", D(2026, 10, 10), []),
    ("Net 30. Interest of 2% 30 days after due date", D(2026, 10, 10), []), ("Net 30 days; 2% 30 days past due", D(2026, 10, 10), []), ("Net 15, 2% 30 days late charge", D(2026, 9, 25), []),
    ("Net 30, 1.5% per month on overdue accounts, 2% 10 days", D(2026, 10, 10), [(200, D(2026, 9, 20))]), ("Net 30 jours, 2% 10 jours, intérêts 1% par mois", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("", None, []), (None, None, []), ("Net 1 month", D(2026, 10, 10), []), ("Net 2 months", D(2026, 11, 10), []), ("2% 10 days, net 1 month", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("1/2% 10 net 30", D(2026, 10, 10), [(50, D(2026, 9, 20))]), ("2/10 net 30 interest 1.5% per month on overdue accounts", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
    ("Net 30, interest of 2% per month charged at end of month on overdue accounts", D(2026, 10, 10), []), ("Net 30 days. Overdue accounts are charged 1.5% at the end of the month", D(2026, 10, 10), []),
    ("Net 30 EOM, interest 2% per month on overdue accounts", D(2026, 10, 30), []), ("Net 30 EOM overdue interest 2% per month", D(2026, 10, 30), []),
    ("Net 2 weeks", D(2026, 9, 24), []), ("Payable within 2 weeks", D(2026, 9, 24), []), ("Net 3 semaines", D(2026, 10, 1), []), ("Net 10 prox", D(2026, 10, 10), []), ("Net 25th prox", D(2026, 10, 25), []),
    ("Net 31 proximo", D(2026, 10, 31), []), ("Net EOM", D(2026, 9, 30), []), ("Due EOM", D(2026, 9, 30), []), ("Payable fin de mois", D(2026, 9, 30), []), ("Due end of month", D(2026, 9, 30), []),
    ("2/10th prox net 30th", D(2026, 10, 30), [(200, D(2026, 10, 10))]), ("2% 10th prox", D(2026, 10, 10), [(200, D(2026, 10, 10))]), ("2% 10 prox, net 25th prox", D(2026, 10, 25), [(200, D(2026, 10, 10))]),
    ("1/10 prox net 25 prox", D(2026, 10, 25), [(100, D(2026, 10, 10))]), ("2/10 prox net 30", D(2026, 10, 10), [(200, D(2026, 10, 10))]), ("2% 2 weeks net 30", D(2026, 10, 10), [(200, D(2026, 9, 24))]),
    ("2% 2 wks, net 45", D(2026, 10, 25), [(200, D(2026, 9, 24))]), ("3/10, 2/20, net 60", D(2026, 11, 9), [(300, D(2026, 9, 20)), (200, D(2026, 9, 30))]), ("2/10 net 1 month", D(2026, 10, 10), [(200, D(2026, 9, 20))]),
]


def read(spark, rows):
    return with_terms(spark.createDataFrame(rows, "n int, t string, d date, c long"), "t", "d", "c").orderBy("n").collect()


def test_forms(spark):
    got = read(spark, [(n, t, D(2026, 9, 10), 10_000) for n, (t, *_) in enumerate(FORMS)])
    wrong = []
    for r, (terms, due, discounts) in zip(got, FORMS, strict=True):
        mine = (r["instalments"][0]["due"] if r["instalments"] else None, [(x["basis_points"], x["by"]) for x in r["discounts"]])
        if mine != (due, discounts):
            wrong.append((terms, mine, (due, discounts)))
        assert sum(x["cents"] for x in r["instalments"]) == (10_000 if due else 0)
    assert not wrong


def test_short_months_and_missing_dates(spark):
    rows = [(1, "net 1 mois", D(2026, 1, 31), 1), (2, "Net 30 prox", D(2026, 1, 31), 1), (3, "Net 30", None, 5), (4, "Net 30", D(2026, 1, 1), None)]
    got = read(spark, rows)
    assert [[x["due"] for x in r["instalments"]] for r in got] == [[D(2026, 2, 28)], [D(2026, 2, 28)], [], []]


@pytest.mark.parametrize("cents", [10_000, 10_001, -10_001, 2, 0])
def test_instalments_add_up(spark, cents):
    r = read(spark, [(1, "Net 30 in 3 payments 15 days apart", D(2026, 9, 10), cents)])[0]
    assert [x["due"] for x in r["instalments"]] == [D(2026, 10, 10), D(2026, 10, 25), D(2026, 11, 9)]
    assert sum(x["cents"] for x in r["instalments"]) == cents and max(x["cents"] for x in r["instalments"]) - min(x["cents"] for x in r["instalments"]) <= 1
    assert read(spark, [(1, "2/10 net 30", D(2026, 9, 10), cents)])[0]["discounts"] == ([(200, D(2026, 9, 20), (cents * 4 + 100) // 200)] if cents > 0 else [])
