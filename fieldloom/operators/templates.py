"""Vendor templates: learned from corrections, checked for corruption, applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.functions.text import first_case

EXAMPLES = 5
BONUS, CORRUPTED = 5.0, 50.0


def rebuilt(corrections: DataFrame) -> DataFrame:
    """vendor_id, field, examples (the newest five distinct values, oldest first),
    occurrences, bbox (median of each side) and page_number (the most frequent, first seen on ties)."""
    keys = ["vendor_id", F.col("field_name").alias("field")]
    values = corrections.groupBy(*keys, "corrected_value").agg(F.max(F.struct("created_at", "id")).alias("seen"))
    newest = Window.partitionBy("vendor_id", "field").orderBy(F.col("seen").desc())
    examples = (
        values.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= EXAMPLES)
        .groupBy("vendor_id", "field")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "corrected_value"))), lambda e: e["corrected_value"]).alias("examples"))
    )
    pages = corrections.groupBy(*keys, "page_number").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "id")).alias("seen")
    )
    page = pages.groupBy("vendor_id", "field").agg(F.min_by("page_number", F.struct((-F.col("n")).alias("n"), "seen")).alias("page_number"))
    sides = corrections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("occurrences"), F.array(*[F.median(F.col("bbox")[i]) for i in range(4)]).alias("bbox")
    )
    return examples.join(sides, ["vendor_id", "field"]).join(page, ["vendor_id", "field"])


def profile(field: Column, value: Column) -> Column:
    """struct of what a value of a field looks like."""
    amount = money.number(value)
    is_money = text.field_type(field) == "monetary"
    return F.struct(
        text.field_type(field).alias("field_type"),
        F.length(value).alias("length"),
        text.shape(value).alias("format_pattern"),
        F.when(is_money, F.length(F.floor(F.abs(amount)).cast("string"))).alias("digit_count"),
        F.when(is_money, money.magnitude(amount)).alias("magnitude"),
    )


def corruption(value: Column, expected: Column) -> Column:
    """Codes of what in a value contradicts the expected profile."""
    amount = money.number(value)
    kind = expected["field_type"]
    own, level = money.magnitude_level(money.magnitude(amount)), money.magnitude_level(expected["magnitude"])
    monetary, identifier = kind == "monetary", kind == "identifier"
    shape = text.shape(value)
    codes = F.array(
        F.when(monetary & (amount < 0), "negative"),
        F.when(monetary & (F.length(F.floor(F.abs(amount)).cast("string")) > expected["digit_count"] + 2), "too_many_digits"),
        F.when(monetary & (F.abs(own - level) > 2), "magnitude_jump"),
        F.when(monetary & value.rlike("2023|2024|2025") & (amount > 10_000), "year_digits"),
        F.when(identifier & (expected["format_pattern"] == "invoice_standard") & value.startswith("-"), "missing_prefix"),
        F.when(identifier & (expected["format_pattern"] == "invoice_standard") & (shape == "numeric_only"), "format_changed"),
        F.when(identifier & (F.abs(F.length(value) - expected["length"]) > 5), "length_mismatch"),
        F.when((kind == "date") & ~value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "no_iso_date"),
        F.when((kind == "currency") & ~value.rlike("^[A-Z]{3}$"), "no_currency_code"),
    )
    return F.array_compact(codes)


def applied(fields: DataFrame, template: DataFrame) -> DataFrame:
    """Fields (doc_id, vendor_id, field, value, confidence) checked against their
    vendor's template: corrupt values get confidence 50 and their codes, the others a bonus."""
    own = template.select("vendor_id", "field", "expected")
    codes = F.when(F.col("expected").isNotNull() & F.col("value").isNotNull(), corruption(F.col("value"), F.col("expected")))
    return (
        fields.join(own, ["vendor_id", "field"], "left")
        .withColumn("codes", codes)
        .select(
            "doc_id",
            "field",
            "value",
            first_case(
                [(F.col("codes").isNull(), F.col("confidence")), (F.size("codes") > 0, F.lit(CORRUPTED))],
                F.least(F.lit(100.0), F.col("confidence") + BONUS),
            ).alias("confidence"),
            F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ",").alias("codes"),
        )
    )


def lacking(documents: DataFrame, fields: DataFrame, template: DataFrame) -> DataFrame:
    """(doc_id, field, suggestion): fields of a vendor's template that a document
    (doc_id, vendor_id) has no value of, with the newest example."""
    have = fields.where(F.coalesce("value", F.lit("")) != "").select("doc_id", "field")
    wanted = documents.select("doc_id", "vendor_id").join(template.select("vendor_id", "field", "examples"), "vendor_id")
    return wanted.join(have, ["doc_id", "field"], "left_anti").select("doc_id", "field", F.try_element_at("examples", F.lit(-1)).alias("suggestion"))


def voter(documents: DataFrame, template: DataFrame, order: int, confidence: float = 85.0) -> DataFrame:
    """Votes of a vendor's template: the first example of each field."""
    return documents.join(template, "vendor_id").select(
        "doc_id",
        F.lit("ocr_template").alias("voter"),
        F.lit(order).alias("voter_ord"),
        "field",
        F.try_element_at("examples", F.lit(1)).alias("value"),
        F.lit(confidence).alias("confidence"),
    )


def statistics(template: DataFrame) -> DataFrame:
    return template.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("fields"), F.sum("occurrences").alias("occurrences"), F.max(F.size("examples")).alias("most_examples")
    )


def recorded(documents: DataFrame, created_at: Column) -> DataFrame:
    """Corrections of documents (doc_id, vendor_id, corrected: map) as rows, one a field that changed or is new.

    ``extracted_data`` gives the value before; the id is a hash of document, field and
    time, so that a repeated write holds the same rows."""
    timed = documents.withColumn("created_at", created_at)
    rows = timed.select("doc_id", "vendor_id", "extracted_data", "created_at", F.explode("corrected").alias("field_name", "corrected_value"))
    before = F.try_element_at("extracted_data", F.col("field_name"))
    return rows.withColumn("original_value", before).where(~F.col("corrected_value").eqNullSafe(F.col("original_value"))).select(
        F.xxhash64("doc_id", "field_name", "created_at").alias("id"), "doc_id", "vendor_id", "field_name", "original_value", "corrected_value", "created_at"
    )


def learned(template: DataFrame, fields: DataFrame) -> DataFrame:
    """A template (vendor_id, field, examples, confidence, occurrences) after new fields
    (vendor_id, field, value, confidence, seen): new values join the examples in the
    order they were first seen and the oldest beyond five leave, the greatest confidence
    stays, occurrences grow.

    Values are counted before vendors meet, so a vendor with many documents is reduced to
    its distinct values first; only the last five of these and the old ones reach one row.
    An example that returns after it left is not told from one that never left, so the
    examples are the last five distinct values by their first sight."""
    usable = fields.where("value is not null and not startswith(field, '_')")
    values = usable.groupBy("vendor_id", "field", "value").agg(
        F.min("seen").alias("seen"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")
    )
    old = template.select("vendor_id", "field", F.explode("examples").alias("value"), F.lit(True).alias("_old"))
    fresh = values.join(old, ["vendor_id", "field", "value"], "left")
    place = F.row_number().over(Window.partitionBy("vendor_id", "field").orderBy(F.col("_old").isNull().desc(), F.col("seen").desc(), F.col("value").desc()))
    newest = fresh.withColumn("place", place).groupBy("vendor_id", "field").agg(
        F.array_sort(F.collect_list(F.when((F.col("place") <= EXAMPLES) & F.col("_old").isNull(), F.struct("seen", "value")))).alias("new"),
        F.max("confidence").alias("new_confidence"),
        F.sum("n").alias("n"),
    )
    examples = F.concat(F.coalesce("examples", F.array().cast("array<string>")), F.coalesce(F.transform("new", lambda e: e["value"]), F.array().cast("array<string>")))
    return template.select("vendor_id", "field", "examples", "confidence", "occurrences").join(newest, ["vendor_id", "field"], "full").select(
        "vendor_id",
        "field",
        F.slice(examples, F.greatest(F.size(examples) - EXAMPLES + 1, F.lit(1)), EXAMPLES).alias("examples"),
        F.greatest("confidence", "new_confidence").alias("confidence"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("occurrences"),
    )


def gated(documents: DataFrame, template: DataFrame, order: int, least: int = 1) -> DataFrame:
    """The template's votes of documents whose vendor is known and whose fields occurred ``least`` times or more."""
    return voter(documents.where("vendor_id is not null"), template.where(F.col("occurrences") >= least), order)


def crop_value(field: Column, crop: Column, as_of: Column) -> Column:
    """What a field takes from the text of its anchored region: a date, an amount, a text
    with a digit, or any text, by the field's type; null if it holds none."""
    kind = text.field_type(field)
    whole = F.nullif(F.trim(F.regexp_replace(crop, r"\s+", " ")), F.lit(""))
    identifier = (kind == "identifier") | F.lower(field).contains("invoice")
    return first_case([(kind == "date", dates.cropped(crop, as_of)), (kind == "monetary", money.cropped_amount(crop)), (identifier, F.when(whole.rlike("[0-9]"), whole))], whole)
