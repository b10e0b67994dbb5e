"""Header lines and scored candidates: vendors of the first lines, and fields of plain
recognised text chosen by score instead of by the first pattern that fits.

Lines are scored by their place and their share of capitals; candidates carry a bonus over
the reading's own confidence and where they stand, a context can veto them, and of one field
the best bonus wins, at equal ones the first place.

Cases: a null text has no lines and no fields; blank lines count as lines for the document
parser and the layout rules and not for the scored ones, as each rule has it; letters of all
scripts can be capitals; confidences stop at 100; a null confidence counts as 0.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import money
from fieldloom.functions.text import CURRENCY_CODES, first_case, first_of, let

# Patterns, words, bonuses and limits.
PARSER_LINES, LAYOUT_LINES, SCORED_LINES, FALLBACK_LINES = 10, 5, 5, 3
NO_COMPANY = ("CUSTOMER", "BILL TO", "SHIP TO", "DATE")
NOT_VENDORS = ("CUSTOMER", "VEHICLE", "ORDER", "DATE", "BILL TO")
# Patterns search whole texts. They give back no character that nothing after it can use, so white space of any length is
# read once, and they look for a plain character before a word's edge, which takes longer to tell.
_GAP = r"[ \t\x0B\f\r]"  # white space within a line
_CAPS = r"A-Z \t\x0B\f\r&.,"
_UPON = r"\A\s*+(?:\S[^\n]*+\n\s*+)"  # upon the first characters of lines that are not blank
COMPANY = (
    rf"{_UPON}{{0,{SCORED_LINES - 1}}}?(?!(?:{'|'.join(NOT_VENDORS)}){_GAP}*+(?:[^{_CAPS}]|\z))"
    rf"([A-Z][{_CAPS}]{{2,}}[A-Z&.,])"
)
FALLBACK, LINE = rf"\A(?:\s*+\S[^\n]*+){{0,{FALLBACK_LINES}}}", r"\S(?:[^\n]*\S)?"
NUMBERS = (
    (r"(?i)invoice\s*+#[:\s]*+([A-Z0-9-]{5,})", 5),
    (r"(?i)invoice\s*+(?:no|number)[:\s]*+([A-Z0-9-]{5,})", 0),
    (r"(?i)order\s*+#[:\s]*+(\d{5,})", -5),
    (r"(?i)#[:\s]*+([A-Z0-9]{5,})", -15),
)
DATE_LIKE = r"^\d{2}[-/]\d{2}[-/]\d{2,4}"
NAMED_DATE = r"(?i)dated?[:\s]*+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# Where a date may stand; it ends no match, as the year of one can begin another.
ANY_DATE = r"(?=\d\d)\b(?=(\d{2}[-/]\d{2}[-/]\d{4}\b|\d{4}[-/]\d{2}[-/]\d{2}\b))"
_YEAR, _MONTH, _DAY = r"(20[0-2]\d|2030)", r"(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])"
DATE_FORMS = (
    (rf"^{_MONTH}([-/]){_DAY}\2{_YEAR}$", "$4-$1-$3"),
    (rf"^{_DAY}([-/]){_MONTH}\2{_YEAR}$", "$4-$3-$1"),
    (rf"^{_YEAR}([-/]){_MONTH}\2{_DAY}$", "$1-$3-$4"),
)
NAMED_TOTALS = (
    r"(?i)(?:invoice total|balance due|amount due|total due)[:\s]*+\$?\s*+([\d,]+\.?\d*)",
    r"(?i)total\s*+\(usd\)[:\s]*+\$?\s*+([\d,]+\.?\d*)",
)
VETO = rf"(?:labor|parts|tax){_GAP}+total"
LINE_TOTAL = rf"(?imd)^(?=[^\n]*?(?=t)\btotal(?:{_GAP}|:)*+\$?{_GAP}*+([\d,]++\.\d{{2}}))(?![^\n]*?{VETO})"
ORDER = r"(?i)p(?:o|\.o\.|urchase order)\s*+#?[:\s]*+([A-Z0-9-]{4,})"
BONUS = {"company": 10, "line": 0, "named_date": 10, "any_date": 0, "named_total": 15, "line_total": 10, "order": 0}
# Words in lower case of which a text holds one wherever the pattern fits; a plain search is faster than the pattern.
NEEDED = {
    ORDER: ("po", "p.o.", "purchase order"), NAMED_DATE: ("date",), LINE_TOTAL: ("total",),
    **dict(zip((p for p, _ in NUMBERS), (("invoice",), ("invoice",), ("order",), ("#",)))),
    **dict(zip(NAMED_TOTALS, (("invoice total", "balance due", "amount due", "total due"), ("(usd)",)))),
}
CURRENCY_SURE, LAYOUT_VENDOR = 95.0, 90.0


def _lines(text: Column, most: int) -> Column:
    return F.transform(F.slice(F.split(text, "\n"), 1, most), _trimmed)


def capitals(line: Column) -> Column:
    """The share of capitals among the characters of a line."""
    return F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / F.length(line)


def parser_vendor(text: Column) -> Column:
    """The first of ten lines that begins with a capital and names no invoice or receipt."""
    fits = lambda x: (F.length(x) > 3) & x.rlike(r"^\p{Lu}") & ~F.lower(x).contains("invoice") & ~F.lower(x).contains("receipt")
    return F.try_element_at(F.filter(_lines(text, PARSER_LINES), fits), F.lit(1))


def parser_currency(text: Column) -> Column:
    """The first currency code that stands as a word, else a sign's."""
    code = first_of(text, r"\b(" + "|".join(CURRENCY_CODES) + r")\b")
    signs = [(text.contains(s), F.lit(c)) for s, c in (("$", "USD"), ("€", "EUR"), ("£", "GBP"))]
    return F.coalesce(code, first_case(signs, F.lit(None).cast("string")))


def layout_vendor(text: Column) -> Column:
    """The first of five lines that is mostly capitals, without a run of digits or a word of addressees."""
    named = lambda x: F.upper(x).rlike("|".join(NO_COMPANY))
    fits = lambda x: (F.length(x) > 5) & (capitals(x) > 0.5) & ~x.rlike(r"\d{3,}") & ~named(x)
    return F.try_element_at(F.filter(_lines(text, LAYOUT_LINES), fits), F.lit(1))


def ladder_currency(text: Column, low: Column | None = None) -> Column:
    """The currency of a sign or a code that stands as a word, in this order; ``low`` is the text in lower case."""
    low = F.lower(text) if low is None else low
    test = lambda sign, code: text.contains(sign) | (low.contains(code.lower()) & text.rlike(rf"(?i)\b{code}\b"))
    cases = [(test(s, c), F.lit(c)) for s, c in (("$", "USD"), ("€", "EUR"), ("£", "GBP"))]
    return F.when(text.isNotNull(), first_case(cases, F.lit("USD")))


def dated(value: Column) -> Column:
    """A date in one of six forms, month-first before day-first, of the years 2000 to 2030, as ISO."""
    written = lambda form, order: F.regexp_replace(value, form, order).try_cast("date").cast("string")
    return F.coalesce(*[F.when(value.rlike(form), written(form, order)) for form, order in DATE_FORMS])


def _trimmed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))


def _row(field: str, value: Column, bonus: int) -> Column:
    """struct(field, value, confidence) of a candidate by its bonus."""
    return F.struct(F.lit(field).alias("field"), value.alias("value"), F.least(F.col("_base") + bonus, F.lit(100.0)).alias("confidence"))


def _first(field: str, values: Column, bonus: int) -> Column:
    """The row of the first of several candidates that is not null; each is computed once."""
    return F.try_element_at(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: _row(field, v, bonus)), F.lit(1))


def _searched(pattern: str) -> Column:
    """What a pattern finds in the text, null if the text holds none of the words that it needs."""
    needed = [F.col("_low").contains(word) for word in NEEDED[pattern]]
    return F.when(reduce(or_, needed), F.regexp_extract("text", pattern, 1))


def scored_vendor(company: Column, text: Column) -> Column:
    """A company's name before a line of capitals, of the first lines that are not blank."""
    sure = lambda x: (F.length(x) > 5) & (capitals(x) > 0.6) & ~x.rlike(r"\d{2,}")
    lines = F.regexp_extract_all(F.regexp_extract(text, FALLBACK, 0), F.lit(LINE), F.lit(0))
    return F.when(company != "", _row("vendor_name", company, BONUS["company"])).otherwise(_first("vendor_name", F.filter(lines, sure), BONUS["line"]))


def scored_number(found: list[Column]) -> Column:
    """The first that is no date, of what the patterns found in the order of their bonuses."""
    accept = lambda v: (F.length(v) >= 4) & v.rlike(r"\d") & ~v.rlike(DATE_LIKE)
    return F.coalesce(*[F.when(accept(v), _row("invoice_number", v, bonus)) for v, (_, bonus) in zip(found, NUMBERS)])


def scored_date(named: Column, text: Column) -> Column:
    """A named date before any other; of these the ones that begin with the year go last."""
    year_first = lambda v: v.substr(5, 1).isin("-", "/")
    every = let(F.regexp_extract_all(text, F.lit(ANY_DATE), F.lit(1)), lambda some: F.concat(F.filter(some, lambda v: ~year_first(v)), F.filter(some, year_first)))
    others = F.when(text.rlike(ANY_DATE), _first("invoice_date", F.transform(every, dated), BONUS["any_date"]))
    return F.when(named.isNotNull(), _row("invoice_date", named, BONUS["named_date"])).otherwise(others)


def scored_total(named: list[Column], of_line: Column) -> Column:
    """Named totals before a line's total, of lines that name no total of labor, parts or tax."""
    amount = lambda v, bonus: F.when(money.number(v).isNotNull(), _row("total_amount", v, bonus))
    return F.coalesce(*[amount(v, BONUS["named_total"]) for v in named], amount(of_line, BONUS["line_total"]))


def scored_fields(documents: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence) of texts (doc_id, text, confidence) by scored candidates.

    Candidates of a field stand in the order of their bonuses, so the first that holds is the
    best. What patterns find in the text are columns of a step of their own: each is searched once
    a text, however often a rule names it, and the rows of a text that found nothing go last.
    Texts are split into lines and into all their dates only where no better candidate holds."""
    plain = lambda p: F.replace(_searched(p), F.lit(","), F.lit(""))
    steps = {
        "company": [F.regexp_extract("text", COMPANY, 1)], "order": [_searched(ORDER)], "number": [_searched(p) for p, _ in NUMBERS],
        "total": [plain(p) for p in (*NAMED_TOTALS, LINE_TOTAL)], "date": [_searched(NAMED_DATE)],
    }
    of = {kind: [f"_{kind}{n}" for n in range(len(some))] for kind, some in steps.items()}
    searched = [c.alias(name) for kind, some in steps.items() for name, c in zip(of[kind], some)]
    read = documents.withColumn("_low", F.lower("text")).select("doc_id", "text", "_low", F.coalesce("confidence", F.lit(0.0)).alias("_base"), *searched)
    read = read.withColumn(*of["date"], dated(F.col(*of["date"])))
    text, found = F.col("text"), {kind: list(map(F.col, names)) for kind, names in of.items()}
    (company,), (order,), (date,), (*totals, of_line) = found["company"], found["order"], found["date"], found["total"]
    rows = F.array(
        scored_vendor(company, text),
        scored_number(found["number"]),
        scored_date(date, text),
        scored_total(totals, of_line),
        F.when(order != "", _row("po_number", order, BONUS["order"])),
        F.when(text.isNotNull(), F.struct(F.lit("currency").alias("field"), ladder_currency(text, F.col("_low")).alias("value"), F.lit(CURRENCY_SURE).alias("confidence"))),
    )
    # A column before it is exploded, as an expression inside explode is interpreted and its type found anew for each row;
    # explode_outer, as explode adds a filter on the size of what it is given, which would make all rows twice.
    return read.select("doc_id", rows.alias("rows")).select("doc_id", F.explode_outer("rows").alias("f")).where("f is not null").select("doc_id", "f.*")


def header_fields(documents: DataFrame) -> DataFrame:
    """Votes of the first lines: the document parser's vendor and currency, the layout rule's vendor, currency and order number."""
    text = F.col("text")
    vote = lambda voter, field, value, c: F.struct(F.lit(voter).alias("voter"), F.lit(field).alias("field"), value.alias("value"), F.lit(c).alias("confidence"))
    rows = (
        vote("docling", "vendor_name", parser_vendor(text), 75.0),
        vote("docling", "currency", parser_currency(text), 75.0),
        vote("layoutlm", "vendor_name", layout_vendor(text), LAYOUT_VENDOR),
        vote("layoutlm", "currency", ladder_currency(text), CURRENCY_SURE),
        vote("layoutlm", "po_number", first_of(text, ORDER), 85.0),
    )
    return documents.select("doc_id", F.array(*rows).alias("rows")).select("doc_id", F.explode_outer("rows").alias("v")).where("v.value is not null").select("doc_id", "v.*")
