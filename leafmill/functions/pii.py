"""Personal data in text: patterns with checksums, in order of priority. Pattern matching only: it can miss things."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.spans import SPACE, guarded, let, regex_spans, resolve_overlaps, shrink_until

# Kinds in order of priority, and their patterns.
KINDS = ["email", "card", "iban", "ssn", "nino", "dob", "ip", "phone"]
# A host has 127 labels at most; the bound keeps a text of very many from filling the stack.
EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,125}\.\p{L}{2,}"
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b"
SSN = r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
NINO = r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b"
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE = rf"(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:\d{{4}}|\d{{2}})|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.?[{SPACE}]+(?:{MONTHS})\.?[{SPACE}]+\d{{4}}|(?:{MONTHS})\.?[{SPACE}]+\d{{1,2}},?[{SPACE}]+\d{{4}})"
BIRTH = "date of birth|birth ?date|d\\.?o\\.?b\\.?|born(?: on)?|geburtsdatum|geboren(?: am)?|date de naissance|né(?:e)? le|fecha de nacimiento|data di nascita"
BIRTH_WORDS = ["birth", "dob", "d.o", "do.b", "born", "gebur", "gebor", "naissance", "né", "nacimiento", "nascita"]
DOB = rf"(?iu)\b(?:{BIRTH})[{SPACE}]*[:\-–]?[{SPACE}]*({DATE})"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d.])"
PHONE = rf"(?<![\w+])(?:\+|00)?\(?\d[\d{SPACE}().-]{{6,18}}\d(?![\w])"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_card(value: Column) -> Column:
    d = digits(value)
    return F.length(d).between(13, 19) & d.rlike("^[2-6]") & ~d.rlike(r"^(\d)\1+$") & F.call_function("luhn_check", d)


def valid_iban(value: Column) -> Column:
    """Country, check digits and 11 to 30 more; moved to the end and read as a number it leaves 1 modulo 97."""
    s = F.upper(F.regexp_replace(value, f"[{SPACE}]", ""))
    turned = F.filter(F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(turned, F.lit(0), lambda r, c: F.when(c >= "A", r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48) % 97)
    return s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1)


def valid_phone(value: Column) -> Column:
    n = F.length(digits(value))
    plain = value.rlike(r"^\d+$") & ~value.rlike(r"^0\d{9,10}$")
    date, decimal = value.rlike(r"^\d{1,4}[./-]\d{1,2}[./-]\d{1,4}$"), value.rlike(r"^\d+\.\d+$")
    led = value.rlike(r"^(?:\+|00|\(|0)") | value.rlike(rf"\d{{3}}[{SPACE}.-]\d{{3}}[{SPACE}.-]\d{{4}}")
    return n.between(8, 15) & ~date & ~plain & ~decimal & led


def _shrunk(spans: Column, valid) -> Column:
    short = F.transform(spans, lambda s: F.struct(shrink_until(s["value"], valid).alias("value"), s["start"].alias("start")))
    kept = F.filter(short, lambda s: s["value"].isNotNull())
    return F.transform(kept, lambda s: F.struct(s["value"].alias("value"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("stop")))


def spans_of(kind: str, text: Column) -> Column:
    """The spans of one kind; a cheap test keeps most rows from its pattern."""
    digit = text.rlike("[0-9]")
    if kind == "email":
        return guarded(text, text.contains("@"), regex_spans(text, EMAIL))
    if kind == "card":
        return guarded(text, digit, _shrunk(regex_spans(text, CARD), valid_card))
    if kind == "iban":
        return guarded(text, digit, _shrunk(regex_spans(text, IBAN), valid_iban))
    if kind == "ssn":
        return guarded(text, digit & text.contains("-"), regex_spans(text, SSN))
    if kind == "nino":
        return guarded(text, digit, regex_spans(text, NINO))
    if kind == "dob":
        # in lower case once, not for each word
        labelled = let(F.lower(text), lambda low: reduce(or_, [low.contains(w) for w in BIRTH_WORDS]))
        return guarded(text, digit & labelled, regex_spans(text, DOB, 1))
    if kind == "ip":
        return guarded(text, digit & text.contains("."), F.filter(regex_spans(text, IP), lambda s: ~s["value"].rlike(r"^[0-2]\.\d\.\d\.\d$")))
    if kind == "phone":
        return guarded(text, digit, F.filter(regex_spans(text, PHONE), lambda s: valid_phone(s["value"])))
    raise ValueError(f"no such kind: {kind}")


def find_pii(text: Column, kinds: list[str] | None = None) -> Column:
    """``kind, value, start, stop`` of all personal data, by position; a later kind never overlaps an earlier one."""
    chosen = [k for k in KINDS if kinds is None or k in kinds]

    def tagged(kind: str) -> Column:
        return F.transform(spans_of(kind, text), lambda s: F.struct(F.lit(kind).alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["stop"].alias("stop")))

    return resolve_overlaps(F.concat(*map(tagged, chosen)))
