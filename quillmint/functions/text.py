"""Reading printed text: provinces of addresses, currencies, kinds of mail, and sentences about a status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmint.functions.keys import fold

# Provinces and territories by code, with the names and short forms that addresses use (folded).
PROVINCES = {
    "AB": ("alberta", "alta"), "BC": ("british columbia", "colombie britannique"), "MB": ("manitoba", "man"), "NB": ("new brunswick", "nouveau brunswick"),
    "NL": ("newfoundland and labrador", "newfoundland", "terre neuve", "nfld"), "NS": ("nova scotia", "nouvelle ecosse"), "NT": ("northwest territories", "nwt"), "NU": ("nunavut",),
    "ON": ("ontario", "ont"), "PE": ("prince edward island", "pei", "ile du prince edouard"), "QC": ("quebec", "que"), "SK": ("saskatchewan", "sask"), "YT": ("yukon",),
}
CURRENCIES = ("CAD", "USD", "EUR", "GBP", "JPY", "CHF", "AUD", "MXN")
POSTAL = "[a-z][0-9][a-z] ?[0-9][a-z][0-9]"


def province(text: Column) -> Column:
    """The province of an address: its end counts first (before a postal code and the country), so that a street named after a province is not it; else the only one named; null where none or several are."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold(text), "\\.", ""), "[^a-z0-9]+", " "))
    tail = F.trim(F.regexp_replace(F.regexp_replace(plain, " ?canada$", ""), f"(^| ){POSTAL}$", ""))
    names = [(name, code) for code, forms in PROVINCES.items() for name in (code.lower(), *forms)]
    names.sort(key=lambda x: -len(x[0]))
    table = F.create_map(*(F.lit(v) for pair in names for v in pair))
    any_of = "|".join(n for n, _ in names)
    last = F.regexp_extract(tail, f"(?:^| )({any_of})$", 1)
    named = F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(f"\\b({'|'.join(n for n, _ in names if len(n) > 3)})\\b"), F.lit(1)), lambda n: F.element_at(table, n)))
    return F.when(last != "", F.element_at(table, last)).when(F.size(named) == 1, F.get(named, F.lit(0)))


def currency_evidence(text: Column) -> Column:
    """struct<currency, sure> of a document's text: a code said to be the amounts' or on a total's line settles it (0.8); the only code elsewhere too; of several the first is a guess (0.5); then signs that only one currency has. Notes on exchange and on how to pay tell nothing. Null where nothing tells."""
    codes = "|".join(CURRENCIES)
    lines = F.filter(F.split(F.upper(text), "\n"), lambda x: ~x.rlike("EXCHANGE|EQUIVALENT|\\b1 [A-Z]{3} ?=|PAYMENTS? .*ACCEPTED|REMIT"))
    whole = F.array_join(lines, "\n")

    def only(pattern: str, group: int = 1) -> Column:
        return F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(group)))

    stated = only(f"(?:AMOUNTS? IN|PRICES? IN|CURRENCY ?:|PAYABLE IN) ?({codes})\\b")
    on_total = only(f"TOTAL[^\\n]*\\b({codes})\\b")
    anywhere = only(f"\\b({codes})\\b")
    one = lambda found, sure: F.when(F.size(found) == 1, F.struct(F.get(found, F.lit(0)).alias("currency"), F.lit(sure).alias("sure")))
    guess = F.when(F.size(anywhere) > 1, F.struct(F.get(anywhere, F.lit(0)).alias("currency"), F.lit(0.5).alias("sure")))
    sign = lambda pattern, code: F.when(whole.rlike(pattern), F.struct(F.lit(code).alias("currency"), F.lit(0.8).alias("sure")))
    return F.coalesce(one(stated, 0.8), one(on_total, 0.8), one(anywhere, 0.8), guess, sign("US\\$|US DOLLARS?", "USD"), sign("CA?\\$|CANADIAN", "CAD"), sign("€", "EUR"), sign("£", "GBP"))


def mail_kind(subject: Column, attachment: Column) -> Column:
    """What an incoming mail is, the first rule that fits: statement, reminder, credit note, purchase order, invoice, other."""
    s = F.concat_ws(" ", fold(subject), fold(attachment))
    rules = (
        ("statement", "\\b(statement|releve|kontoauszug)\\b"), ("reminder", "\\b(reminder|overdue|past due|rappel|mahnung)\\b"), ("credit note", "\\b(credit (note|memo)|avoir|note de credit|gutschrift)\\b"),
        ("purchase order", "\\b(purchase order|bon de commande|bestellung)\\b"), ("invoice", "\\b(invoice|facture|rechnung|inv)[^a-z]*"),
    )
    kind = F.lit("other")
    for name, pattern in reversed(rules):
        kind = F.when(s.rlike(pattern), name).otherwise(kind)
    return kind


def next_to_act(status: Column, reviewer: Column, days: Column) -> Column:
    """Who has to do what with an invoice, as a sentence."""
    since = F.format_string("for %d day%s", days.cast("int"), F.when(days == 1, "").otherwise("s"))
    who = F.coalesce(F.nullif(reviewer, F.lit("")), F.lit("Anyone"))
    return (
        F.when(status == "review", F.concat_ws(" ", who, F.lit("reviews it, waiting"), since)).when(status == "pending_approval", F.concat_ws(" ", F.lit("An approver decides, waiting"), since))
        .when(status == "approved", F.lit("Nobody: it is approved")).otherwise(F.lit("Nobody: it is closed"))
    )
