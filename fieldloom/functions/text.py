"""Text rules: keys, identifiers, currencies and shapes. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a vendor key drops, in this order, wherever it stands.
LEGAL_SUFFIXES = (r"\s*corp\.?", r"\s*corporation", r"\s*inc\.?", r"\s*incorporated", r"\s*llc", r"\s*ltd\.?", r"\s*limited", r"\s*co\.?", r"\s*company")
DOCUMENT_WORDS = (r"\s*receipt", r"\s*invoice", r"\s*bill")
STOP_WORDS = ("the", "and", "of", "for", "at", "in", "on")
# Currencies.
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR")
CURRENCY_SYMBOLS = (
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("C$", "CAD"), ("A$", "AUD"), ("CHF", "CHF"), ("Fr", "CHF"),
)
MERGED_CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY")
CURRENCY_SEARCH = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "INR", "CNY")
CURRENCY_HINTS = (
    ("EUR", ("€", "euro", "eur", "francia", "deutschland", "italia")),
    ("GBP", ("£", "pound", "sterling", "gbp", "britain", "uk")),
    ("CAD", ("c$", "cad", "canada", "canadian")),
    ("AUD", ("a$", "aud", "australia", "australian")),
)


def first_of(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one or if it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_case(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def vote_key(value: Column) -> Column:
    """Votes agree if these keys do: trimmed, lower case, one space for any white space."""

    def spaced(low: Column) -> Column:
        runs = low.contains("  ")
        for mark in "\t\n\x0b\f\r":
            runs = runs | low.contains(mark)
        return F.trim(F.when(runs, F.regexp_replace(low, r"\s+", " ")).otherwise(low))  # most votes hold single spaces only

    return spaced(F.lower(F.coalesce(value, F.lit(""))))


def simple_key(value: Column) -> Column:
    return F.lower(F.trim(value))


def token_key(value: Column, keep: str = "a-z0-9#") -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), f"[^{keep}]", "")


def vendor_key(name: Column) -> Column:
    """A vendor name reduced to letters and digits without suffixes and stop words."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for pattern in (*LEGAL_SUFFIXES, *DOCUMENT_WORDS, r"[^a-z0-9\s]", r"\s+"):
        out = F.regexp_replace(out, pattern, "")
    for word in STOP_WORDS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def fingerprint(name: Column) -> Column:
    key = vendor_key(name)
    return F.when(key != "", F.substring(F.sha2(key, 256), 1, 16))


def vendor_clean(name: Column) -> Column:
    """A usable vendor name, null if it is none."""
    out = F.regexp_replace(F.regexp_replace(F.trim(name), r"^[~@#$%^&*()_+=\[\]{};:\"|<>?/\\]+", ""), r"\s+", " ")
    bad = (F.length(name) < 3) | ~out.rlike("[A-Za-z]{2,}") | out.rlike(r"(?i)\b(?:Bill\s+To|Customer|Client|Recipient)\b")
    return F.when(~bad, out)


# The patterns of this rule.
def number_clean(value: Column) -> Column:
    """An invoice number without its label, null if it cannot be one."""
    out = F.regexp_replace(F.trim(value), r"(?i)^(?:invoice|order|#|no\.?)[\s:]+", "")
    good = out.rlike(r"[0-9]") & ~out.rlike(r"^[0-9]{2}[-/][0-9]{2}[-/][0-9]{2,4}$") & F.length(out).between(4, 30)
    return F.when(good, out)


def number_simple(value: Column) -> Column:
    """An invoice number with single spaces and without leading dashes; empty for none."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), "^-+", "")


def zip_like(value: Column, text: Column) -> Column:
    """Whether a value is five digits that the text writes after a state's two capitals."""
    digits = F.trim(value)
    return digits.rlike("^[0-9]{5}$") & F.regexp_like(F.coalesce(text, F.lit("")), F.concat(F.lit(r"\b[A-Z]{2}\s+"), digits, F.lit(r"\b")))


def same_reading(found: Column, expected: Column) -> Column:
    """Whether a reading counts as the expected one: equal without case and spaces, or one holds the other where both are longer than five."""
    a, b = (F.replace(F.lower(F.trim(c.cast("string"))), F.lit(" "), F.lit("")) for c in (found, expected))
    long = (F.length(a) > 5) & (F.length(b) > 5)
    return F.coalesce((a == b) | (long & (a.contains(b) | b.contains(a))), F.lit(False))


def label_key(value: Column) -> Column:
    """A label's words: lower case, other characters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9#]+", " "))


# The patterns of this rule.
def number_pattern(value: Column) -> Column:
    """struct(valid, number, reason) of an invoice number."""
    reason = first_case(
        [
            (F.coalesce(value, F.lit("")) == "", F.lit("empty")),
            (value.rlike(r"^[0-9]{8}$"), F.lit("date of 8 digits")),
            (value.rlike(r"^[0-9]{6}$"), F.lit("date of 6 digits")),
            (~value.rlike("[0-9]"), F.lit("no digit")),
            (F.length(value) < 3, F.lit("too short")),
            (F.length(value) > 30, F.lit("too long")),
        ],
        F.lit("valid"),
    )
    return F.struct((reason == "valid").alias("valid"), F.when(reason == "valid", value).alias("number"), reason.alias("reason"))


def last_number(value: Column) -> Column:
    """The last run of digits as a long."""
    return F.regexp_extract(value, r"([0-9]+)[^0-9]*$", 1).try_cast("long")


# The patterns of this rule.
def po_clean(value: Column) -> Column:
    out = F.regexp_replace(F.trim(value), r"(?i)^(?:po|p\.o\.|purchase order)\s*#?\s*:?\s*", "")
    return F.when((F.length(out) >= 4) & out.rlike("[A-Za-z0-9]{4,}"), out)


def currency_valid(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when(code.isin(*CURRENCY_CODES), code).otherwise(F.lit("USD"))


def currency_clean(value: Column) -> Column:
    """A code of the eight that merged records hold, else the first three capitals, else USD."""
    code = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(code.isin(*MERGED_CODES), code).otherwise(F.coalesce(first_of(code, "[A-Z]{3}", 0), F.lit("USD")))


def currency_of(text: Column) -> Column:
    """The currency of the first of $, € and £ that a text holds, else USD."""
    return first_case([(text.contains("$"), F.lit("USD")), (text.contains("€"), F.lit("EUR")), (text.contains("£"), F.lit("GBP"))], F.lit("USD"))


def currency_infer(amount_text: Column, text: Column) -> Column:
    """struct(code, confidence) from symbols, then codes, then words, else USD."""
    amount_text, text = F.coalesce(amount_text, F.lit("")), F.coalesce(text, F.lit(""))
    low = F.lower(text)
    made = lambda code, confidence: F.struct(F.lit(code).alias("code"), F.lit(confidence).alias("confidence"))
    cases = [(amount_text.contains(s) | text.contains(s), made(code, 95.0)) for s, code in CURRENCY_SYMBOLS]
    # a plain search rules most codes out before a pattern is tried
    cases += [(low.contains(code.lower()) & text.rlike(rf"(?i)\b{code}\b"), made(code, 90.0)) for code in CURRENCY_SEARCH]
    for code, hints in CURRENCY_HINTS:
        any_of = F.lit(False)
        for hint in hints:
            any_of = any_of | low.contains(hint)
        cases.append((any_of, made(code, 75.0)))
    return first_case(cases, made("USD", 50.0))


def digit_repair(value: Column) -> Column:
    """Letters that are read for digits."""
    for letter, digit in zip("OoIlSB", "001158"):  # several times as fast as a translation where there are few
        value = F.replace(value, F.lit(letter), F.lit(digit))
    return value


def id_normalise(value: Column) -> Column:
    mended = digit_repair(value)
    return F.when(mended.rlike("[0-9]"), F.regexp_replace(mended, r"[^A-Za-z0-9-]", ""))


# The patterns of this rule.
def shape(value: Column) -> Column:
    return first_case(
        [
            (value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit("date_iso")),
            (value.rlike(r"^[A-Z]{2,5}-[0-9]{4,}-[0-9]{2,}$"), F.lit("invoice_standard")),
            (value.rlike(r"^-[0-9]+"), F.lit("invoice_broken_prefix")),
            (value.rlike(r"^[0-9]+$"), F.lit("numeric_only")),
            (value.rlike(r"^[A-Z]{3}$"), F.lit("currency_code")),
            (value.rlike("[a-zA-Z]") & value.rlike("[0-9]"), F.lit("alphanumeric")),
        ],
        F.lit("text"),
    )


def field_type(name: Column) -> Column:
    low = F.lower(name)
    return first_case(
        [
            (low.rlike("amount|total|price"), F.lit("monetary")),
            (low.contains("date"), F.lit("date")),
            (low.rlike("number|num|id"), F.lit("identifier")),
            (low.rlike("name|vendor"), F.lit("name")),
            (low.contains("currency"), F.lit("currency")),
        ],
        F.lit("generic"),
    )


def truncated(value: Column, size: int) -> Column:
    return F.when(F.length(value) > size, F.concat(F.substring(value, 1, size), F.lit("..."))).otherwise(value)


def file_size(size: Column) -> Column:
    """Bytes with a unit: 0 Bytes, 1.5 KB, 2 MB."""
    step = F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) / 10).cast("int"), F.lit(3))
    shown = F.round(size / F.pow(F.lit(1024.0), step), 2)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", shown), r"0+$", ""), r"\.$", "")
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(
        F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), step + 1))
    )


def fixed(value: Column, digits: int) -> Column:
    """A double with so many decimals, rounded by its exact binary value, exact halves to even, as C's printf does."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def title(value: Column) -> Column:
    return F.initcap(F.replace(F.lower(value), F.lit("_"), F.lit(" ")))
