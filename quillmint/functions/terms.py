"""Payment terms as printed: net days, weeks, months, a day of the next month, discounts, instalments, as dates and cents.

A term is read in steps, each a few regular expressions: what is said of interest and late payment goes first, then
discounts are taken out, and what is left says when the rest is due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER, _DAYS, _WEEKS, _MONTHS = r"\d+(?:\.\d+)?", r"(?:days?|jours?|jrs?)", r"(?:weeks?|wks?|semaines?)", r"(?:months?|mois)"
_REST = r"(?:[^,;.]|\.\d)*"  # up to the end of the clause
_INTEREST = [
    rf"{_NUMBER}\s*%\s*(?:interest|int[ée]r[êe]ts?)?\s*(?:per|par|/|a)\s*(?:month|mois|year|annum|an)\b",
    rf"{_NUMBER}\s*%\s*\d+\s*{_DAYS}\s*(?:past|after|late|overdue|interest|en retard|apr[èe]s){_REST}",
    rf"{_NUMBER}\s*%\s*\d+\s*(?:{_MONTHS}|ans?|years?)\b{_REST}",
    rf"(?:interest|int[ée]r[êe]ts?)\b{_REST}",
    rf"(?:overdue|past due|late fee|en retard)\b{_REST}",
    r"\bdue\s+\d{1,2}/\d{1,2}(?:/\d{2,4})?",
]
_DISCOUNT = rf"(?<![\d.])(1/2(?=\s*%)|{_NUMBER})\s*[%/]\s*(?:escompte\s*|discount\s*|if paid within\s*)?(\d+)(?:st|nd|rd|th)?\s*({_DAYS}|{_WEEKS})?\s*(eom|fin de mois|prox(?:imo)?)?\b"
_SPLIT = rf"\b(?:in|en)\s+(\d+)\s+(?:equal\s+)?(?:payments?|instal?lments?|versements?)(?:\s*,?\s*(\d+)\s*{_DAYS}\s*(?:apart|d'intervalle))?"
_EOM = r"\beom\b|\bend of (?:the )?month\b|\bfin de mois\b"
LEFT_OPEN_DAYS, BETWEEN_SPLITS = 20, 30  # to the net date after an end-of-month discount without one; between instalments


def _day_of_next_month(day: Column, date: Column) -> Column:
    first = F.add_months(F.trunc(date, "month"), 1)
    return F.least(F.date_add(first, day.cast("int") - 1), F.last_day(first))


def with_terms(rows: DataFrame, terms: str, date: str, cents: str) -> DataFrame:
    """The rows with ``discounts``, array<struct<basis_points, by, cents>>, and ``instalments``, array<struct<due, cents>>.

    The instalments add up to ``cents`` exactly, the first ones taking what does not divide; terms that are not
    understood, and rows without a date, have no instalments. A credit (below zero) has no discounts. A discount's cents
    are half up.
    """
    said = F.lower(F.trim(F.coalesce(F.col(terms), F.lit(""))))
    for pattern in _INTEREST:
        said = F.regexp_replace(said, pattern, " ")
    at, own = F.col(date), rows.columns
    part = lambda text, pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    step = rows.withColumn("_said", said)
    found = F.arrays_zip(*(F.regexp_extract_all("_said", F.lit(_DISCOUNT), F.lit(g)).alias(n) for g, n in enumerate(("p", "n", "unit", "from"), 1)))
    step = step.withColumns({
        "_found": found, "_splits": part(F.col("_said"), _SPLIT).cast("int"), "_apart": part(F.col("_said"), _SPLIT, 2).cast("int"),
        "_rest": F.regexp_replace(F.regexp_replace("_said", _DISCOUNT, " , "), _SPLIT, " "),
    })

    def discount(x: Column) -> Column:
        points = F.when(x["p"] == "1/2", 50).otherwise(F.round(x["p"].try_cast("decimal(9,4)") * 100).cast("int"))
        days = x["n"].cast("int") * F.when(x["unit"].rlike(_WEEKS), 7).otherwise(1)
        by = F.when(x["from"].startswith("prox"), _day_of_next_month(x["n"], at)).when(x["from"] != "", F.date_add(F.last_day(at), days)).otherwise(F.date_add(at, days))
        amount = F.call_function("div", F.col(cents).cast("long") * points * 2 + 10_000, F.lit(20_000))
        return F.struct(points.alias("basis_points"), by.alias("by"), amount.alias("cents"))

    real = F.filter("_found", lambda x: (x["p"].try_cast("double") > 0) | (x["p"] == "1/2"))
    step = step.withColumns({"_first": F.get("_found", F.lit(0)), "discounts": F.when(F.col(cents) > 0, F.transform(F.filter(real, lambda x: x["n"] != ""), discount)).otherwise(F.expr("cast(array() as array<struct<basis_points: int, by: date, cents: bigint>>)"))})
    rest, first = F.col("_rest"), F.get(F.transform("_found", discount), F.lit(0))["by"]
    eom = rest.rlike(_EOM) | (F.col("_first")["from"].rlike("eom|fin"))
    start = F.when(F.coalesce(eom, F.lit(False)), F.last_day(at)).otherwise(at)
    prox = F.coalesce(part(rest, r"(\d+)(?:st|nd|rd|th)?\s*prox"), F.when(F.col("_first")["from"].startswith("prox"), part(rest, r"\bnet\s*(\d+)(?:st|nd|rd|th)\b")))
    months = part(rest, rf"\b(?:net|n)\s*/?\s*(\d+)\s*{_MONTHS}").cast("int")
    weeks = part(rest, rf"(\d+)\s*{_WEEKS}").cast("int")
    days = F.coalesce(part(rest, r"\b(?:net|n)\s*/?\s*(\d+)"), part(rest, rf"(\d+)\s*{_DAYS}")).cast("int")
    due = F.coalesce(
        F.when(prox.isNotNull(), _day_of_next_month(prox, at)), F.when(months.isNotNull(), F.add_months(start, months)), F.when(weeks.isNotNull(), F.date_add(start, weeks * 7)),
        F.when(days.isNotNull(), F.date_add(start, days)), F.when(rest.rlike(r"\b(?:on|upon|sur)\s+(?:receipt|r[ée]ception)\b"), at), F.when(F.col("_first")["from"].startswith("prox"), first),
        F.when(F.col("_first")["from"].rlike("eom|fin"), F.date_add(first, LEFT_OPEN_DAYS)), F.when(rest.rlike(_EOM), F.last_day(at)),
    )
    step = step.withColumn("_due", due)
    n, whole = F.greatest(F.coalesce("_splits", F.lit(1)), F.lit(1)), F.col(cents).cast("long")

    def instalment(i: Column) -> Column:
        # Each takes what lies between two even marks of the whole, so the parts add up.
        share = F.call_function("div", F.abs(whole), n) + F.when(i < F.abs(whole) % n, 1).otherwise(0)
        return F.struct(F.date_add("_due", (i * F.coalesce("_apart", F.lit(BETWEEN_SPLITS))).cast("int")).alias("due"), (F.signum(whole.cast("double")).cast("long") * share).alias("cents"))

    parts = F.when(F.col("_due").isNotNull() & whole.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), instalment)).otherwise(F.expr("cast(array() as array<struct<due: date, cents: bigint>>)"))
    return step.withColumn("instalments", parts).select(*own, "discounts", "instalments")
