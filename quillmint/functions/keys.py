"""Comparison keys for names, numbers and registrations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that end a company name.
LEGAL_FORMS = ("inc", "incorporated", "ltd", "ltee", "limited", "limitee", "corp", "corporation", "co", "company", "llc", "llp", "lp", "ulc", "sa", "gmbh", "plc", "enr")


def _folded(c: str) -> str:
    """A character decomposed (compatibility form), without marks, in folded case."""
    plain = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d)).casefold()
    plain = "".join(d for d in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(d))
    return plain.replace("œ", "oe").replace("æ", "ae")


def folded(x: str) -> str:
    """What ``fold`` makes of a text."""
    return "".join(map(_folded, x))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Letters of the Latin, Greek, Cyrillic, full-width and number-form blocks that fold to one character, and to several."""
    blocks = ((0xA0, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
    pairs = {chr(i): _folded(chr(i)) for a, b in blocks for i in range(a, b) if not unicodedata.combining(chr(i)) and _folded(chr(i)) != chr(i)}
    single = {c: p for c, p in pairs.items() if len(p) == 1}
    return "".join(single), "".join(single.values()), {c: p for c, p in pairs.items() if len(p) > 1 and c.isalpha()}


_ONE, _ONE_PLAIN, _MANY = _fold_tables()


def fold(x: Column) -> Column:
    """Folded case without accents, ligatures and compatibility forms; a null stays null."""
    plain = F.regexp_replace(F.translate(F.lower(x), _ONE, _ONE_PLAIN), "\\p{Mn}", "")
    several = plain
    for c, p in _MANY.items():
        several = F.replace(several, F.lit(c), F.lit(p))
    return F.when(plain.rlike("[" + "".join(_MANY) + "]"), several).otherwise(plain)


def name_key(x: Column) -> Column:
    """A company name without case, accents, punctuation and trailing legal forms; a name of legal forms alone stays."""
    words = F.trim(F.regexp_replace(F.regexp_replace(fold(x), "&", " and "), "[^a-z0-9]+", " "))
    bare = F.regexp_replace(words, "( (" + "|".join(LEGAL_FORMS) + "))+$", "")
    return bare


def number_key(x: Column) -> Column:
    """An invoice number in lower case letters and digits, without a leading label and leading zeros."""
    plain = F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    bare = F.regexp_replace(plain, "^(invoice|facture|inv|no)(?=[0-9])", "")
    short = F.regexp_replace(bare, "^0+", "")
    return F.when(short == "", F.when(bare == "", None).otherwise(F.lit("0"))).otherwise(short)


def padded(x: Column, width: int = 5) -> Column:
    """A company code: digits padded with zeros, other codes as they are in upper case."""
    return F.when(x.rlike("^[0-9]+$"), F.lpad(x, width, "0")).otherwise(F.upper(F.trim(x)))


def order_key(company: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws("-", padded(company), F.upper(kind), F.regexp_replace(number, "^0+", ""))


def registration_key(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))


def same_account(a: Column, b: Column) -> Column:
    """Registrations of one business: equal first nine digits."""
    return (F.length(registration_key(a)) >= 9) & (F.substring(registration_key(a), 1, 9) == F.substring(registration_key(b), 1, 9))


def supplier_key(master_id: Column, registration: Column, name: Column) -> Column:
    """The strongest identity there is: master id, then registration, then name."""
    tag = lambda t, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(t), v))
    return F.coalesce(tag("id:", master_id), tag("bn:", F.substring(registration_key(registration), 1, 9)), tag("name:", name_key(name)))


def masked(x: Column, shown: int = 4) -> Column:
    """All but the last digits of an account starred."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(digits) - shown, F.lit(0))), F.right(digits, F.lit(shown)))


def first_words(x: Column, n: int = 4) -> Column:
    """The first words of two or more letters: the pattern of a line description."""
    return F.array_join(F.slice(F.regexp_extract_all(fold(x), F.lit("[a-z]{2,}"), F.lit(0)), 1, n), " ")


def remark_shape(x: Column) -> Column:
    """A remark without numbers and months, so that monthly remarks agree."""
    months = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
    bare = F.regexp_replace(F.regexp_replace(fold(x), f"\\b({months})[a-z]*\\b", " "), "[^a-z]+", " ")
    return F.trim(bare)


def safe_cell(x: Column) -> Column:
    """A spreadsheet cell that cannot start a formula; numbers stay numbers."""
    risky = x.rlike("^[=+@\\t\\r-]") & ~x.rlike("^[+-]?([0-9][0-9,]*)?(\\.[0-9]+)?$")
    return F.when(risky, F.concat(F.lit("'"), x)).otherwise(x)


def account(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(x, "[^0-9]", ""))
