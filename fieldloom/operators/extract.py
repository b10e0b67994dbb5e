"""Field extraction from text, cell grids and tagged sequences by ordered rules.

A producer is a table of rules: for each field, patterns in order of priority
with a group and a confidence. The first pattern whose value is acceptable
wins. Rules compile to one struct(value, confidence, rule_no) column per field,
so a document is read once, inside the scan's stage, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text


@dataclass(frozen=True)
class Rule:
    pattern: str
    group: int = 1
    confidence: float = 75.0

# The patterns of each producer, in order; (?i) marks those that are searched in either case.
DOCUMENT_PARSER = {
    "invoice_number": (
        Rule(r"(?i)invoice\s*#?\s*:?\s*([A-Z0-9\-/]+)"),
        Rule(r"(?i)invoice\s+number\s*:?\s*([A-Z0-9\-/]+)"),
        Rule(r"(?i)document\s+number\s*:?\s*([A-Z0-9\-/]+)"),
        Rule(r"(?i)#\s*([A-Z]{2,5}[-/]?\d{4,}[-/]?\d+)"),
    ),
    "invoice_date": (
        Rule(r"(?i)invoice\s+date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
        Rule(r"(?i)date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
        Rule(r"(?i)issued\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
        Rule(r"(?i)(\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4})"),
    ),
    "due_date": (Rule(r"(?i)due\s+date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"), Rule(r"(?i)payment\s+due\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})")),
    "total_amount": (
        Rule(r"(?i)(?:grand\s+)?total\s*:?\s*\$?\s*([\d,]+\.?\d*)"),
        Rule(r"(?i)amount\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)"),
        Rule(r"(?i)balance\s+due\s*:?\s*\$?\s*([\d,]+\.?\d*)"),
    ),
    "subtotal": (Rule(r"(?i)subtotal\s*:?\s*\$?\s*([\d,]+\.?\d*)"),),
    "tax_amount": (Rule(r"(?i)tax\s*:?\s*\$?\s*([\d,]+\.?\d*)"),),
}
LAYOUT_TEXT = {
    "invoice_number": (
        Rule(r"(?i)(?:invoice|order)\s*#?\s*:?\s*([A-Z0-9-]{5,})", 1, 95.0),
        Rule(r"(?i)inv\.?\s*#?\s*:?\s*([A-Z0-9-]{5,})", 1, 90.0),
        Rule(r"(?i)#\s*([A-Z0-9]{5,})", 1, 85.0),
    ),
    "invoice_date": (Rule(r"(?i)(?:date|invoice date|dated)[:\s]*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", 1, 90.0),),
    "total_amount": (
        Rule(r"(?i)(?:invoice total|balance due|amount due|total due)[:\s]*\$?\s*([\d,]+\.?\d*)", 1, 95.0),
        Rule(r"(?i)total\s*\(usd\)[:\s]*\$?\s*([\d,]+\.?\d*)", 1, 90.0),
        Rule(r"(?i)\btotal[:\s]*\$?\s*([\d,]+\.\d{2})", 1, 85.0),
    ),
    "po_number": (Rule(r"(?i)(?:po|p\.o\.|purchase order)\s*#?[:\s]*([A-Z0-9-]{4,})", 1, 85.0),),
}
TAGGED = {
    "vendor_name": (Rule(r"<s_nm>\s*([A-Z][A-Z\s&\.]+(?:RECEIPT|INC|LLC)?)"),),
    "invoice_number": (Rule(r"(?i)Order\s*#\s*(\d{5,})"), Rule(r"(?i)Invoice\s*#?\s*([A-Z0-9-]{5,})"), Rule(r"<s_price>\s*(\d{6,})\s*</s_price>")),
    "invoice_date": (Rule(r"(\d{2}-\d{2}-\d{4})"),),
    "total_amount": (
        Rule(r"(?i)Invoice Total[:\s]*\$?\s*([\d,]+\.\d{2})"),
        Rule(r"(?i)Balance Due[:\s]*\$?\s*([\d,]+\.\d{2})"),
        Rule(r"(?i)Total[:\s]*\$?\s*([\d,]+\.\d{2})"),
        Rule(r"(?s).*<s_price>\s*([\d,]+\.\d{2})"),
    ),
}
TEXT_VOTER = {
    "invoice_number": (
        Rule(r"(?i)(?:invoice|inv|no\.?)\s*[:#-]?\s*([A-Za-z0-9][-A-Za-z0-9]{2,})"),
        Rule(r"\b([A-Za-z0-9]{3,}[-/][A-Za-z0-9]{2,})\b"),
        Rule(r"\b([A-Za-z]*\d[A-Za-z0-9-]{2,})\b"),
    ),
}
CELLS = {
    "invoice_number": (
        Rule(r"(?i)INVOICE\s*#?\s*:?\s*([A-Z0-9-]+)", 1, 95.0),
        Rule(r"(?i)INV[-\s#:]([A-Z0-9-]+)", 1, 95.0),
        Rule(r"(?i)Invoice\s*No\.?\s*:?\s*([A-Z0-9-]+)", 1, 95.0),
    ),
    "invoice_date": (
        Rule(r"(?i)INVOICE\s*DATE\s*:?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})", 1, 95.0),
        Rule(r"(?i)Date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", 1, 95.0),
        Rule(r"(\d{4}-\d{2}-\d{2})", 1, 95.0),
        Rule(r"(?i)(October|November|December|January|February|March|April|May|June|July|August|September)\s+\d{1,2},?\s+\d{4}", 0, 95.0),
    ),
    "total_amount": (
        Rule(r"(?i)TOTAL\s*:?\s*\$?([\d,]+\.?\d{0,2})", 1, 95.0),
        Rule(r"(?i)Grand\s*Total\s*:?\s*\$?([\d,]+\.?\d{2})", 1, 95.0),
        Rule(r"(?i)Amount\s*Due\s*:?\s*\$?([\d,]+\.?\d{2})", 1, 95.0),
        Rule(r"\$\s*([\d,]+\.\d{2})", 1, 95.0),
    ),
    "vendor_name": (
        Rule(r"(?i)From\s*:?\s*([A-Za-z][A-Za-z\s&]+)", 1, 95.0),
        Rule(r"(?i)Vendor\s*:?\s*([A-Za-z][A-Za-z\s&]+)", 1, 95.0),
        Rule(r"(?i)Supplier\s*:?\s*([A-Za-z][A-Za-z\s&]+)", 1, 95.0),
    ),
}
#: What a cell must hold for any pattern of the field to match it.
CELL_SIGNS = {"invoice_number": "(?i)inv", "invoice_date": r"\d{2}", "total_amount": r"(?i)total|amount|\$", "vendor_name": "(?i)from|vendor|supplier"}
PLACEHOLDERS = {
    "invoice_number": ("TEMPLATE", "EXAMPLE", "SAMPLE", "YOUR", "COMPANY"),
    "vendor_name": ("TEMPLATE", "INVOICE", "EXAMPLE", "SAMPLE", "YOUR", "COMPANY", "VENDOR"),
    "total_amount": ("TOTAL",),
    "invoice_date": (),
}
ADDRESS = r"(?i)\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd)[,\s]+[\w\s]+,\s*[A-Z]{2}\s+\d{5}"
SCHEDULE = r"(?is)up to \d{4}|payment.*schedule|payment.*terms|due.*\d{4}-\d{2}-\d{2}"
LABELLED_TOTALS = (
    Rule(r"(?i)invoice\s+total[:\s]*\$?\s*([\d,]+\.\d{2})"),
    Rule(r"(?i)balance\s+due[:\s]*\$?\s*([\d,]+\.\d{2})"),
    Rule(r"(?i)total\s+amount[:\s]*\$?\s*([\d,]+\.\d{2})"),
    Rule(r"(?i)grand\s+total[:\s]*\$?\s*([\d,]+\.\d{2})"),
)


def compiled(source: Column, rules: tuple[Rule, ...], accept=None) -> Column:
    """struct(value, confidence, rule_no) of the first rule with an acceptable value, null without one."""
    found = []
    for k, rule in enumerate(rules):
        value = F.trim(text.first_of(source, rule.pattern, rule.group))
        good = value.isNotNull() & (value != "")
        if accept is not None:
            good = good & F.coalesce(accept(value), F.lit(False))
        found.append(F.when(good, F.struct(value.alias("value"), F.lit(rule.confidence).alias("confidence"), F.lit(k).alias("rule_no"))))
    return F.coalesce(*found)


def amount_of(value: Column) -> Column:
    return money.number(F.replace(value, F.lit(","), F.lit("")))


_ACCEPT = {
    "invoice_number": lambda v: v.rlike("[0-9]"),
    "total_amount": lambda v: amount_of(v).isNotNull(),
    "subtotal": lambda v: amount_of(v).isNotNull(),
    "tax_amount": lambda v: amount_of(v).isNotNull(),
}


def voted(documents: DataFrame, rules: dict[str, tuple[Rule, ...]], voter: str, voter_ord: int, source: str = "text") -> DataFrame:
    """The votes of a producer over documents (doc_id, text)."""
    columns = {f: compiled(F.col(source), r, _ACCEPT.get(f)) for f, r in rules.items()}
    rows = documents.select("doc_id", *[c.alias(f) for f, c in columns.items()])
    entries = F.array_compact(
        F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.confidence").alias("confidence"))) for f in columns])
    )
    return rows.select("doc_id", F.lit(voter).alias("voter"), F.lit(voter_ord).alias("voter_ord"), F.explode(entries).alias("e")).select(
        "doc_id", "voter", "voter_ord", "e.field", "e.value", "e.confidence"
    )


def text_voter(source: Column) -> Column:
    """struct of currency, total_amount, invoice_date, due_date and invoice_number of plain text."""
    low = F.lower(source)
    symbol = text.first_case([(source.contains(s), F.lit(c)) for s, c in text.CURRENCY_SYMBOLS[:5]], F.lit(None).cast("string"))
    code = F.upper(text.first_of(low, r"\b(usd|eur|gbp|jpy|inr|aud|cad|chf|cny)\b"))
    every = lambda pattern, group: F.regexp_extract_all(low, F.lit(pattern), F.lit(group))
    # fixed values: patterns of totals, dates and codes in plain text
    labelled = F.concat(
        every(r"(?:grand\s+)?total[^0-9]{0,20}([-+]?[0-9][0-9.,]{1,})", 1), every(r"(?:amount\s+due)[^0-9]{0,20}([-+]?[0-9][0-9.,]{1,})", 1)
    )
    numbers = F.when(F.size(labelled) > 0, labelled).otherwise(every(r"[-+]?[0-9][0-9.,]{2,}", 0))
    usable = F.filter(numbers, lambda n: ~(n.contains("-") & (F.length(n) <= 6)))
    amounts = F.filter(F.transform(usable, money.decimal_value), lambda a: a.isNotNull())
    written = lambda pattern: F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    shown = F.array_distinct(
        F.concat(
            written(r"[A-Za-z]{3,9}\s+\d{1,2},\s*\d{2,4}"),
            written(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"),
            written(r"\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}"),
        )
    )
    found = F.filter(F.transform(shown, dates.cleaned), lambda d: d.isNotNull())
    number = text.number_clean(compiled(source, TEXT_VOTER["invoice_number"])["value"])
    return F.struct(
        F.coalesce(symbol, code).alias("currency"),
        F.try_element_at(amounts, F.lit(1)).alias("total_amount"),
        F.try_element_at(found, F.lit(1)).alias("invoice_date"),
        F.try_element_at(found, F.lit(2)).alias("due_date"),
        number.alias("invoice_number"),
    )


def from_cells(cells: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence from cells (doc_id, row, col, value): the
    first acceptable match in the order pattern, column, row."""
    none = F.array().cast("array<struct<field: string, rule_no: int, raw: string>>")

    def tried(field: str, rules: tuple[Rule, ...]) -> Column:
        """The field's matches; cells without its cheap sign are not searched."""

        def match(k: int, rule: Rule) -> Column:
            raw = text.first_of(F.col("value"), rule.pattern, rule.group)
            named = lambda v: F.struct(F.lit(field).alias("field"), F.lit(k).alias("rule_no"), F.trim(v).alias("raw"))
            return F.transform(F.array_compact(F.array(raw)), named)

        made = F.concat(*[match(k, rule) for k, rule in enumerate(rules)])
        return F.when(F.col("value").rlike(CELL_SIGNS[field]), made).otherwise(none)

    found = F.concat(*[tried(f, rules) for f, rules in CELLS.items()])
    hits = cells.select("doc_id", "row", "col", F.explode(found).alias("h")).select(
        "doc_id", "row", "col", "h.field", "h.rule_no", "h.raw"
    )
    raw, field = F.col("raw"), F.col("field")
    skipped = F.lit(False)
    for name, words in PLACEHOLDERS.items():
        for word in words:
            skipped = skipped | ((field == name) & F.upper(raw).contains(word))
    name = F.trim(F.regexp_replace(raw, r"[^A-Za-z\s&]", ""))
    value = (
        F.when((field == "invoice_number") & raw.rlike("[0-9]"), raw)
        .when(field == "invoice_date", dates.flexible(raw))
        .when((field == "total_amount") & (amount_of(raw) != 0), amount_of(raw).cast("string"))
        .when((field == "vendor_name") & (F.length(name) >= 3), name)
    )
    good = hits.where(~skipped).withColumn("value", value).where("value is not null")
    first = F.min_by("value", F.struct("rule_no", "col", "row"))
    return good.groupBy("doc_id", "field").agg(first.alias("value")).withColumn("confidence", F.lit(95.0))


def all_amounts(source: Column) -> Column:
    found = F.transform(F.regexp_extract_all(source, F.lit(r"\$?\s*([\d,]+\.\d{2})\b"), F.lit(1)), amount_of)
    return F.filter(found, lambda a: (a > 0) & (a < 1_000_000))


def schedule_total(source: Column, extracted: Column) -> Column:
    """The total of a text that may hold a payment schedule."""
    amounts = all_amounts(source)
    labelled = amount_of(compiled(source, LABELLED_TOTALS)["value"])
    return text.first_case(
        [(F.size(amounts) == 0, extracted), ((F.size(amounts) >= 3) & source.rlike(SCHEDULE), F.array_max(amounts))],
        F.coalesce(labelled, extracted),
    )


def chosen_total(source: Column, amounts: Column, items_sum: Column) -> Column:
    """Of several amounts: one named total, else the largest outside subtotal and tax
    lines, else the one closest to the items within 5 %, else the largest."""
    named = F.transform(F.regexp_extract_all(source, F.lit(r"(?i)(?:grand\s+)?total\s*:?\s*\$?\s*([\d,\.]+)"), F.lit(1)), amount_of)
    by_label = F.try_element_at(F.filter(named, lambda n: F.exists(amounts, lambda a: F.abs(a - n) < 0.01)), F.lit(1))
    low = F.lower(source)

    def context(amount: Column) -> Column:
        at = F.instr(low, F.format_string("%.2f", amount))
        return F.when(at > 0, F.substring(low, F.greatest(at - 50, F.lit(1)), F.lit(100))).otherwise(F.lit(""))

    clean = F.filter(amounts, lambda a: ~context(a).rlike("subtotal|tax|vat|gst|discount"))
    nearest = F.array_min(F.transform(amounts, lambda a: F.struct(F.abs(a - items_sum).alias("off"), a.alias("amount"))))
    return text.first_case(
        [
            (F.size(amounts) <= 1, F.try_element_at(amounts, F.lit(1))),
            (by_label.isNotNull(), by_label),
            (F.size(clean) > 0, F.array_max(clean)),
            (nearest["off"] < items_sum * 0.05, nearest["amount"]),
        ],
        F.array_max(amounts),
    )


def addresses(source: Column) -> Column:
    """struct(vendor_address, customer_address): the first two street addresses."""
    found = F.regexp_extract_all(source, F.lit(ADDRESS), F.lit(0))
    return F.struct(F.trim(F.try_element_at(found, F.lit(1))).alias("vendor_address"), F.trim(F.try_element_at(found, F.lit(2))).alias("customer_address"))


def section(source: Column, labels: str) -> Column:
    """The lines after a label such as From or Bill To, up to a blank line."""
    return F.trim(text.first_of(source, rf"(?is)\b(?:{labels})\s*:?\s*(.+?)(?:\n\s*\n|$)"))


def parser_confidence(n_fields: Column, key_fields: Column, tables: Column, pages: Column, missing_number: Column, missing_total: Column) -> Column:
    """Confidence of the document parser from what it found."""
    score = (
        40 + F.least(n_fields * 4, F.lit(25)) + key_fields * 5 + F.when(tables > 0, 12).otherwise(0) + F.when(pages > 1, 3).otherwise(0) + 8
        - F.when(missing_number, 15).otherwise(0) - F.when(missing_total, 10).otherwise(0)
    )
    return F.greatest(F.lit(10), F.least(F.lit(95), score)).cast("double")


def best_per_field(candidates: DataFrame) -> DataFrame:
    """Of candidates (doc_id, field, value, score, ord) the best, the first on ties."""
    order = Window.partitionBy("doc_id", "field").orderBy(F.col("score").desc(), "ord")
    return candidates.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
