"""Query by example: what a person types over a column becomes a condition.

Grammar by kind of column:
  text     contains; ``=x`` exact; ``*`` and ``?`` wildcards; ``!`` not; ``empty`` and ``!empty``. Case and accents do not count.
  amount   ``1250``, ``>1000``, ``>=``, ``<``, ``<=``, ``100..250`` in either order (0.005 of tolerance), ``!`` not (null counts as 0).
  date     ``2024``, ``2024-03``, ``2024-03-05``, ranges of them with ``..``; ``>``, ``<`` and ``!``.
  choice   comma-separated values; ``!`` not.
A filter that cannot be read is reported and dropped; the others still apply.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmint.functions.keys import fold, folded


def _fold_text(x: str) -> str:
    return folded(x)


def text_filter(column: str, typed: str) -> Column:
    typed = typed.strip()
    deny, typed = typed.startswith("!"), typed.removeprefix("!").strip()
    blank = F.col(column).isNull() | (F.trim(F.col(column)) == "")
    if typed.lower() == "empty":
        return ~blank if deny else blank
    if not typed:
        raise ValueError("nothing to look for")
    x = F.coalesce(fold(F.col(column)), F.lit(""))
    if typed.startswith("="):
        found = x == _fold_text(typed[1:].strip())
    elif re.search(r"[*?]", typed):
        pattern = re.sub(r"([%_\\])", r"\\\1", _fold_text(typed)).replace("*", "%").replace("?", "_")
        found = x.like(pattern)
    else:
        found = x.contains(_fold_text(typed))
    return ~found if deny else found


_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def amount_filter(column: str, typed: str) -> Column:
    typed = re.sub(r"[\s,$]", "", typed)
    deny, typed = typed.startswith("!"), typed.removeprefix("!")
    x = F.coalesce(F.col(column).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")) if deny else F.col(column).cast("decimal(18,4)")
    number = lambda v: F.lit(v).cast("decimal(18,4)")
    if m := re.fullmatch(f"({_NUMBER})\\.\\.({_NUMBER})", typed):
        low, high = sorted(m.groups(), key=float)
        found = x.between(number(low) - number("0.005"), number(high) + number("0.005"))
    elif m := re.fullmatch(f"(>=|<=|>|<)({_NUMBER})", typed):
        v = number(m[2])
        found = {">": x > v, "<": x < v, ">=": x >= v, "<=": x <= v}[m[1]]
    elif re.fullmatch(_NUMBER, typed):
        found = x.between(number(typed) - number("0.005"), number(typed) + number("0.005"))
    else:
        raise ValueError(f"no amount: {typed}")
    return ~found if deny else found


def _span(typed: str) -> tuple[dt.date, dt.date]:
    """First day and the day after the last of a year, month or day."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", typed)
    if not m:
        raise ValueError(f"no date: {typed}")
    y, mo, d = int(m[1]), m[2] and int(m[2]), m[3] and int(m[3])
    if d:
        start = dt.date(y, mo, d)
        return start, start + dt.timedelta(1)
    if mo:
        start = dt.date(y, mo, 1)
        return start, start + dt.timedelta(calendar.monthrange(y, mo)[1])
    return dt.date(y, 1, 1), dt.date(y + 1, 1, 1)


def date_filter(column: str, typed: str) -> Column:
    typed = re.sub(r"\s", "", typed)
    deny, typed = typed.startswith("!"), typed.removeprefix("!")
    x = F.col(column)
    if ".." in typed:
        a, b = (_span(t) for t in typed.split("..", 1))
        start, end = min(a[0], b[0]), max(a[1], b[1])
        found = (x >= F.lit(start)) & (x < F.lit(end))
    elif typed[:1] in "<>" and typed:
        start, end = _span(typed[1:])
        found = x >= F.lit(end) if typed[0] == ">" else x < F.lit(start)
    else:
        start, end = _span(typed)
        found = (x >= F.lit(start)) & (x < F.lit(end))
    return ~F.coalesce(found, F.lit(False)) if deny else found


def choice_filter(column: str, typed: str) -> Column:
    typed = typed.strip()
    deny, typed = typed.startswith("!"), typed.removeprefix("!")
    values = list(dict.fromkeys(v.strip() for v in typed.split(",") if v.strip()))
    if not values:
        raise ValueError("no choice")
    found = F.col(column).isin(values)
    return ~F.coalesce(found, F.lit(False)) if deny else found


KINDS = {"text": text_filter, "amount": amount_filter, "date": date_filter, "choice": choice_filter}


def by_example(df: DataFrame, typed: Mapping[str, str], kinds: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """The rows that satisfy every readable filter, and what could not be read."""
    problems: dict[str, str] = {}
    for column, text in typed.items():
        if not text.strip():
            continue
        try:
            df = df.where(KINDS[kinds[column]](column, text))
        except (ValueError, KeyError) as e:
            problems[column] = str(e)
    return df, problems


def glob(x: Column, pattern: str) -> Column:
    """A whole-string match with ``*``, ``?`` and ``[...]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            inside = pattern[i + 1 : end]
            out += "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return x.rlike(f"^(?s:{out})$")


def after_key(df: DataFrame, keys: list[str], last: list, n: int) -> DataFrame:
    """The next page after a key tuple, by key order: no offset to count through."""
    page = F.struct(*keys) > F.struct(*(F.lit(v).cast(df.schema[k].dataType) for k, v in zip(keys, last, strict=True)))
    return df.where(page).orderBy(*keys).limit(n)


def nulls_last(column: str, descending: bool = False) -> list[Column]:
    """Blank values after all others, whatever the direction; case does not count."""
    x = F.lower(F.col(column).cast("string"))
    return [F.coalesce(x == "", F.lit(True)).asc(), x.desc() if descending else x.asc()]
