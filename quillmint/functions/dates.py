"""Dates: typed parsing, Julian dates, cadence, reporting windows and payment terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def julian(d: Column) -> Column:
    """A date as CYYDDD: century since 1900, year of it, day of the year."""
    return (F.year(d) - 1900) * 1000 + F.dayofyear(d)


def from_julian(n: Column) -> Column:
    year = F.floor(n / 1000).cast("int") + 1900
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (n % 1000).cast("int") - 1)


def cadence(days: Column) -> Column:
    """The name of a gap in days."""
    limits = ((10, "weekly"), (20, "every two weeks"), (45, "monthly"), (75, "every two months"), (110, "quarterly"))
    label = F.lit("other")
    for most, name in reversed(limits):
        label = F.when(days <= most, name).otherwise(label)
    return label


def period_end(today: Column) -> Column:
    """Month end to report on: the prior month's in a month's first week, else this month's."""
    return F.when(F.dayofmonth(today) <= 7, F.last_day(F.add_months(today, -1))).otherwise(F.last_day(today))


def previous_quarter(today: Column) -> tuple[Column, Column]:
    start = F.add_months(F.trunc(today, "quarter"), -3)
    return start, F.date_sub(F.trunc(today, "quarter"), 1)


def last_months(today: Column, n: int = 12) -> tuple[Column, Column]:
    return F.add_months(F.trunc(today, "month"), 1 - n), today


def parsed_date(x: Column, day_first: bool = True) -> Column:
    """ISO, Julian-free typed dates: year first, then the order that the file's unambiguous rows show."""
    orders = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    text = F.regexp_replace(F.trim(x), "[.\\-]", "/")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy/M/d", *orders)))


def parsed_amount(x: Column) -> Column:
    """A typed amount: thousands separators, decimal comma or point, parentheses, a trailing minus or CR for credits."""
    bare = F.regexp_replace(F.upper(F.trim(x)), "[$€£\\s ]", "")
    credit = bare.rlike("^\\(.*\\)$|-$|CR$|^-")
    digits = F.regexp_replace(bare, "[()\\-]|CR|DR", "")
    french = digits.rlike("^[0-9.]*,[0-9]{1,2}$")
    plain = F.when(french, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    value = plain.try_cast("decimal(18,2)")
    return F.when(credit, -value).otherwise(value)


def due_dates(terms: Column, invoice_date: Column) -> Column:
    """struct<due, discount_due, discount_rate> of payment terms: net n, d/n net m, end of month plus n, on receipt."""
    t = F.lower(F.trim(terms))
    number = lambda pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).cast("int")
    net = F.coalesce(number("net ?([0-9]+)", 1), number("^n ?([0-9]+)$", 1), F.when(t.rlike("receipt"), F.lit(0)))
    month_end = number("(?:eom|end of month) ?\\+? ?([0-9]+)", 1)
    due = F.when(t.rlike("eom|end of month"), F.date_add(F.last_day(invoice_date), F.coalesce(month_end, F.lit(0)))).otherwise(F.date_add(invoice_date, net))
    rate = F.nullif(F.regexp_extract(t, "([0-9.]+) ?%? ?/ ?[0-9]+", 1), F.lit("")).cast("decimal(9,4)")
    days = number("[0-9.]+ ?%? ?/ ?([0-9]+)", 1)
    return F.struct(due.alias("due"), F.date_add(invoice_date, days).alias("discount_due"), rate.alias("discount_rate"))


def order_of_dates(x: Column) -> Column:
    """Aggregate: whether a file's slashed dates put the day first, told by its unambiguous rows; null where none tells or they disagree."""
    text = F.regexp_replace(F.trim(x), "[.\\-]", "/")
    first, second = (F.nullif(F.regexp_extract(text, "^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}$", k), F.lit("")).cast("int") for k in (1, 2))
    day, month = F.bool_or((first > 12) & (second <= 12)), F.bool_or((second > 12) & (first <= 12))
    return F.when(day & ~month, F.lit(True)).when(month & ~day, F.lit(False))


def printed_amount(x: Column) -> Column:
    """An amount as documents print it: currency signs and codes around it, spaces, apostrophes, points or commas between thousands, a decimal comma or point with two digits, parentheses, a minus before or behind, CR or DR.

    One separator with exactly three digits behind is read as thousands; text that is no amount gives null.
    """
    bare = F.regexp_replace(F.upper(F.trim(x)), "CAD|USD|EUR|GBP|[$€£\\s\u00a0\u202f'’]", "")
    credit = bare.rlike("^\\(.+\\)$|-$|CR$|^-")
    digits = F.regexp_replace(bare, "^[(+-]|[)-]$|(CR|DR)$", "")
    digits = F.regexp_replace(digits, "^-|-$", "")
    cents = F.nullif(F.regexp_extract(digits, "^[0-9][0-9.,]*[.,]([0-9]{1,2})$", 1), F.lit(""))
    whole = F.when(cents.isNotNull(), F.regexp_replace(digits, "[.,][0-9]{1,2}$", "")).otherwise(digits)
    grouped = whole.rlike("^[0-9]+$|^[0-9]{1,3}(,[0-9]{3})+$|^[0-9]{1,3}(\\.[0-9]{3})+$")
    value = F.concat(F.regexp_replace(whole, "[.,]", ""), F.lit("."), F.coalesce(cents, F.lit("0"))).try_cast("decimal(18,2)")
    return F.when(grouped, F.when(credit, -value).otherwise(value))
