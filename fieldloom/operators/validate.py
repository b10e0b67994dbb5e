"""Validation: document types, cross-field checks, confidences and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.functions.text import first_case, first_of

# Words that tell a document's type.
CREDIT_WORDS = ("credit note", "credit memo", "credit memorandum", "return", "refund", "adjustment credit", "cn")
QUOTE_WORDS = ("quote", "quotation", "estimate", "proforma", "proposal", "pro forma", "estimated invoice")
COMPANY_WORDS = (
    "inc", "llc", "ltd", "limited", "corp", "corporation", "company", "co", "enterprises", "group", "services", "solutions",
    "industries", "partners", "associates", "holdings", "international", "global", "technologies", "systems", "consulting",
    "agency", "studio", "gmbh", "sarl", "srl", "plc", "pty", "ag", "spa", "nv",
)
# Where a text names its sender and its receiver.
SENDER = (r"(?i)from\s*:?\s*(.{5,100})", r"(?i)vendor\s*:?\s*(.{5,100})", r"(?i)supplier\s*:?\s*(.{5,100})")
RECEIVER = (r"(?i)bill\s+to\s*:?\s*(.{5,100})", r"(?i)customer\s*:?\s*(.{5,100})", r"(?i)client\s*:?\s*(.{5,100})")
TOLERANCE = 0.02
#: Codes that no reviewer needs to see.
INFORMATIONAL = ("credit", "no_charge", "very_round", "zero", "negative")
#: Corrections that a reviewer must see.
CRITICAL_CORRECTIONS = ("total_corrected", "vendor_corrected", "date_reformatted")


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))  # words are letters and spaces


def document_type(text: Column, total: Column) -> Column:
    """struct(kind, confidence) of a document."""
    low = F.lower(F.coalesce(text, F.lit("")))
    made = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    return first_case(
        [
            (low.contains("credit note"), made("credit_note", 90.0)),
            (holds_any(low, CREDIT_WORDS), made("credit_note", 75.0)),
            (total < 0, made("credit_note", 85.0)),
            (low.contains("quote") | low.contains("quotation"), made("quote", 90.0)),
            (holds_any(low, QUOTE_WORDS), made("quote", 75.0)),
            (low.contains("invoice"), made("invoice", 95.0)),
        ],
        made("invoice", 60.0),
    )


def vendor_check(vendor: Column, customer: Column) -> Column:
    """Why a vendor is doubtful, null if it is not."""
    v, c = F.lower(vendor), F.lower(customer)
    person = vendor.rlike(r"^\s*[A-Z]\S*\s+[A-Z]\S*\s*$") & ~holds_any(v, COMPANY_WORDS)
    return first_case(
        [
            (F.coalesce(vendor, F.lit("")) == "", F.lit("missing")),
            (v == c, F.lit("equals_customer")),
            (v.contains(c) | c.contains(v), F.lit("like_customer")),
            (person & (F.coalesce(customer, F.lit("")) != ""), F.lit("person")),
        ],
        F.lit(None).cast("string"),
    )


def items_against_total(totals: DataFrame, items: DataFrame) -> DataFrame:
    """totals (doc_id, total) and items (doc_id, amount): sums, difference and whether they match."""
    sums = items.groupBy("doc_id").agg(
        F.round(F.sum("amount"), 2).alias("items_sum"), F.count(F.lit(1)).alias("items"), F.count("amount").alias("readable")
    )
    off = F.round(F.abs(F.col("items_sum") - F.col("total")), 2)
    return totals.join(sums, "doc_id", "left").select(
        "doc_id",
        "total",
        "items_sum",
        F.coalesce("items", F.lit(0)).alias("items"),
        F.coalesce("readable", F.lit(0)).alias("readable"),
        off.alias("difference"),
        F.round(money.percent_difference(F.col("total"), F.col("items_sum")), 1).alias("percent"),
        F.coalesce(off <= TOLERANCE, F.lit(True)).alias("matches"),
    )


def misread_amount(amount: Column, text: Column) -> Column:
    """The amount that the text writes, if ``amount`` is a misreading of its comma or thousands; null otherwise."""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    full = r"([0-9]{1,3})\.([0-9]{3}),([0-9]{2})\b"
    short = r"([0-9]+),([0-9]{2})\b"
    as_double = lambda *parts: F.concat(*parts).try_cast("double")
    dot = F.lit(".")

    def suggestions(pieces: Column, right, wrong) -> Column:
        hits = F.filter(pieces, lambda p: F.exists(wrong(p), lambda w: F.abs(amount - w) < 0.01))
        return F.transform(hits, right)

    three = F.arrays_zip(found(full, 1).alias("a"), found(full, 2).alias("b"), found(full, 3).alias("c"))
    two = F.arrays_zip(found(short, 1).alias("a"), found(short, 2).alias("b"))
    first = suggestions(
        three,
        lambda p: as_double(p["a"], p["b"], dot, p["c"]),
        lambda p: F.array(as_double(p["a"], dot, p["b"], p["c"]), as_double(p["a"], dot, p["b"]), as_double(p["a"])),
    )
    second = suggestions(two, lambda p: as_double(p["a"], dot, p["b"]), lambda p: F.array(as_double(p["a"], p["b"]), as_double(p["a"])))
    return F.try_element_at(F.concat(first, second), F.lit(1))


def overall_confidence(confidences: Column, codes: Column) -> Column:
    """Mean confidence less 5 for each warning that is no mere information, at most 30; not below 0."""
    mean = F.aggregate(confidences, F.lit(0.0), lambda s, c: s + c) / F.size(confidences)
    critical = F.size(F.filter(codes, lambda c: ~c.isin(*INFORMATIONAL)))
    return F.when(F.size(confidences) > 0, F.round(F.greatest(F.lit(0.0), mean - F.least(critical * 5, F.lit(30))), 2)).otherwise(F.lit(0.0))


def lowered(confidence: Column, by: float, floor: float) -> Column:
    return F.greatest(F.lit(floor), confidence - by)


def vendor_suggestion(vendor: Column, reason: Column, text: Column) -> Column:
    """struct(name, code): for a person the first company among the text's first fifteen
    lines, for a name that stands under Bill To and not under From the name under From."""
    known = lambda line: holds_any(F.lower(line), COMPANY_WORDS)
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 15), lambda line: F.trim(line))
    fits = lambda line: known(line) & F.length(line).between(6, 99) & ~F.lower(line).contains(F.lower(vendor))
    company = F.try_element_at(F.filter(lines, fits), F.lit(1))
    sender, receiver = (F.coalesce(*[F.trim(first_of(text, p)) for p in patterns]) for patterns in (SENDER, RECEIVER))
    low = F.lower(vendor)
    swapped = reason.isNull() & ~known(vendor) & ~F.lower(sender).contains(low) & F.lower(receiver).contains(low) & (F.length(sender) > 3)
    made = lambda name, code: F.struct(name.alias("name"), code.alias("code"))
    nothing = made(F.lit(None).cast("string"), reason)
    return first_case([((reason == "person") & company.isNotNull(), made(company, reason)), (swapped, made(sender, F.lit("wrong_section")))], nothing)


def known_vendor_mismatch(vendor: Column, known: Column) -> Column:
    """Whether a vendor is neither the known one nor a part or extension of its name; false where either is missing."""
    v, k = F.lower(F.trim(vendor)), F.lower(F.trim(known))
    return F.coalesce((v != "") & (k != "") & ~v.contains(k) & ~k.contains(v), F.lit(False))


def with_items_and_vendors(fields: DataFrame, items: DataFrame, known: DataFrame) -> DataFrame:
    """Fields with what their items (doc_id, amount) and known vendor (doc_id, vendor_name) say.

    All three meet by doc_id alone, items in partial sums, so each is dealt once."""
    sums = items.groupBy("doc_id").agg(
        F.sum(F.col("amount").cast("decimal(20,4)")).cast("double").alias("items_sum"), F.count(F.lit(1)).alias("items"), F.count("amount").alias("items_readable")
    )
    names = known.groupBy("doc_id").agg(F.min("vendor_name").alias("known_vendor"))
    return fields.join(sums, "doc_id", "left").join(names, "doc_id", "left")


def extra_warnings(codes: Column, poor_image: Column, several_invoices: Column) -> Column:
    """Codes with those of the whole upload before them, the last test first."""
    return F.array_compact(F.concat(F.array(F.when(several_invoices, "several_invoices"), F.when(poor_image, "image_quality")), codes))


#: Fields whose confidences the overall one averages.
CHECKED = ("vendor_name", "invoice_number", "invoice_date", "due_date", "payment_terms", "total_amount", "currency")


def validated(fields: DataFrame, as_of: Column) -> DataFrame:
    """One row a document of raw fields to checked ones.

    ``fields`` holds doc_id, text, vendor_name, customer_name, invoice_number, invoice_date,
    due_date, total_text, currency and the map ``confidences`` by field. An unreadable date
    is looked for in the text; terms in place of a due date take its confidence; a missing
    currency is inferred. Steps follow each other as projections, so each row is read once
    and nothing is shuffled. Nulls: a missing due date is no fault, other missing values are.

    With the columns of :func:`with_items_and_vendors` the items must sum to the total, a round
    total must be near them, and the vendor be the known one; documents without items or a
    known vendor pass. A column po_number is cleaned and passed on.
    """
    crossed, ordered = "items_sum" in fields.columns, "po_number" in fields.columns
    amount = money.total_check(F.col("_amount"))
    reason = vendor_check(F.col("vendor_name"), F.col("customer_name"))
    number = text.number_clean(F.col("invoice_number"))
    cleaned = fields.withColumn("_amount", money.decimal_value(F.col("total_text"))).withColumns(
        {
            "number": number,
            "_reason": reason,
            "_date": dates.cleaned(F.col("invoice_date")),
            "terms": F.coalesce(dates.terms_days(F.col("due_date")), dates.terms_days(F.col("text"))),
            "_due": dates.cleaned(F.col("due_date")),
            "total": amount,
            "type": document_type(F.col("text"), F.col("_amount")),
        }
    )
    year = F.substring("date", 1, 4).cast("int")
    hint = first_of(F.col("number"), r"(20\d{2})").cast("int")
    dated = cleaned.withColumns(
        {
            "_suggested": vendor_suggestion(F.col("vendor_name"), F.col("_reason"), F.col("text")),
            "date": F.when(F.col("_date").isNotNull(), F.col("_date")).otherwise(dates.recovered(F.col("text"), dates.INVOICE_DATE_LABELS, None, hint)),
        }
    )
    wants_due = F.col("due_date").isNotNull() & F.col("terms").isNull()
    year = F.coalesce(year, hint)
    found_due = dates.recovered(F.col("text"), dates.DUE_DATE_LABELS, year, year)
    due = dated.withColumn("due", F.when(wants_due, F.when(F.col("_due").isNotNull(), F.col("_due")).otherwise(found_due)))
    inferred = text.currency_infer(F.col("total_text"), F.col("text"))["code"]
    no_currency = F.coalesce("currency", F.lit("")) == ""
    step = due.withColumns(
        {
            "vendor": F.coalesce("_suggested.name", "vendor_name"),
            "code": F.when(no_currency, inferred).otherwise(text.currency_valid(F.col("currency"))),
            "misread": misread_amount(F.col("total.amount"), F.col("text")),
            "plausible": money.plausibility(F.col("total.amount")),
            "dates": dates.consistency(F.col("date"), F.col("due"), as_of),
        }
    )
    marked = lambda test, code: F.when(test, code)
    has_items, sums = F.coalesce(F.col("items"), F.lit(0)) > 0, F.coalesce("items_sum", F.lit(0.0))
    off = F.round(F.abs(sums - F.col("total.amount")), 4)
    cross_codes = (
        marked(has_items & (F.col("total.amount") != 0) & (off > TOLERANCE), "items_differ"),
        F.when(has_items, money.round_suspicion(F.col("total.amount"), sums)),
        marked(known_vendor_mismatch(F.col("vendor"), F.col("known_vendor")), "vendor_mismatch"),
    )
    codes = F.array(
        F.concat(F.lit("vendor_"), F.col("_suggested.code")),
        marked(F.col("number").isNull(), "number_invalid"),
        marked(F.col("date").isNull(), "date_invalid"),
        marked(wants_due & F.col("due").isNull(), "due_invalid"),
        F.col("total.warning"),
        F.when(~F.col("plausible.ok"), F.col("plausible.code")),
        marked(F.col("misread").isNotNull(), "decimal_misread"),
        F.col("dates"),
        *(cross_codes if crossed else ()),
    )
    po = text.po_clean(F.col("po_number"))
    corrections = F.array(
        marked(F.col("_suggested.name").isNotNull(), "vendor_corrected"),
        marked(F.col("number") != F.col("invoice_number"), "number_cleaned"),
        marked(F.col("_date") != F.col("invoice_date"), "date_reformatted"),
        marked(F.col("_date").isNull() & F.col("date").isNotNull(), "date_from_text"),
        marked(F.col("terms").isNotNull(), "terms_from_text"),
        marked(wants_due & (F.col("_due") != F.col("due_date")), "due_reformatted"),
        marked(wants_due & F.col("_due").isNull() & F.col("due").isNotNull(), "due_from_text"),
        marked(F.col("misread").isNotNull(), "total_corrected"),
        marked(no_currency, "currency_inferred"),
        *((marked(po != F.col("po_number"), "po_cleaned"),) if ordered else ()),
    )
    held = F.col("confidences")
    of = lambda field: F.try_element_at(held, F.lit(field))
    less = lambda test, field, by, floor: F.when(test, lowered(of(field), by, floor)).otherwise(of(field))
    due_lost = wants_due & F.col("due").isNull()
    confidences = {
        "vendor_name": less(F.col("_suggested.code").isNotNull(), "vendor_name", 20, 60),
        "invoice_number": less(F.col("number").isNull(), "invoice_number", 15, 70),
        "invoice_date": less(F.col("date").isNull(), "invoice_date", 50, 30),
        "due_date": F.when(F.col("terms").isNull(), less(due_lost, "due_date", 50, 30)),
        "payment_terms": F.when(F.col("terms").isNotNull(), F.greatest(of("payment_terms"), of("due_date"))),
        "total_amount": less(F.col("misread").isNotNull(), "total_amount", 10, 85),
        "currency": of("currency"),
    }
    done = step.withColumns(
        {
            "codes": F.array_compact(codes),
            "corrections": F.array_compact(corrections),
            "_confidences": F.array_compact(F.array(*[confidences[f].cast("double") for f in CHECKED])),
        }
    )
    critical = F.exists("codes", lambda c: ~c.isin(*INFORMATIONAL)) | F.arrays_overlap("corrections", F.array(*map(F.lit, CRITICAL_CORRECTIONS)))
    return done.withColumn("overall_confidence", overall_confidence(F.col("_confidences"), F.col("codes"))).select(
        "doc_id",
        "vendor",
        "number",
        "date",
        F.col("due").alias("due_date"),
        F.col("terms").alias("payment_terms"),
        F.coalesce("misread", F.col("total.amount")).alias("total"),
        F.col("code").alias("currency"),
        F.col("type.kind").alias("document_type"),
        F.array_join("codes", ",").alias("codes"),
        F.array_join("corrections", ",").alias("corrections"),
        "overall_confidence",
        (critical | (F.col("overall_confidence") < 85) | (F.col("type.kind") == "credit_note")).alias("needs_review"),
        *((F.when(has_items, F.round(off, 2)).alias("items_difference"),) if crossed else ()),
        *((po.alias("po_number"),) if ordered else ()),
    )
