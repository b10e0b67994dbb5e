"""Fusion of several engines' readings, override of votes, and pages into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.operators.extract import best_per_field

FUSED_VOTER = "ocr_fused"
FOOTER_CONFIDENCE = 60


def fused(candidates: DataFrame) -> DataFrame:
    """The best candidate of each field and the document's fused confidence."""
    best = best_per_field(candidates)
    scores = Window.partitionBy("doc_id")
    confidence = F.least(F.lit(95.0), F.greatest(F.lit(50.0), F.round(F.avg("score").over(scores) * 100, 2)))
    return best.select("doc_id", "field", "value", "score", confidence.alias("fused_confidence"))


def overrides(votes: DataFrame, forced: tuple[str, ...] = (), texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, value) where the fused reading replaces the vote: of forced
    fields, of dates and numbers that no other voter reads validly, and of totals with
    decimals against sure footers or undecimalled others, and of totals that another
    voter takes from a postal code of the document (``texts``: doc_id, text)."""
    clean = (
        F.when(F.col("field").isin("invoice_date", "due_date"), dates.cleaned(F.col("value")))
        .when(F.col("field") == "invoice_number", text.number_clean(F.col("value")))
        .when(F.col("field") == "po_number", text.po_clean(F.col("value")))
        .when(F.col("field") == "total_amount", money.decimal_value(F.col("value")).cast("string"))
    )
    own = F.col("voter") == FUSED_VOTER
    given = F.coalesce("value", F.lit("")) != ""
    if texts is None:
        near = votes.withColumn("_zip", F.lit(False))
    else:  # only documents whose total some voter reads as five digits need their text
        doubtful = votes.where((F.col("field") == "total_amount") & ~own & F.col("value").rlike(r"^\s*[0-9]{5}\s*$"))
        zips = (
            doubtful.join(texts.select("doc_id", "text"), "doc_id")
            .where(text.zip_like(F.col("value"), F.col("text")))
            .select("doc_id", "field", F.lit(True).alias("_zip"))
            .distinct()
        )
        near = votes.join(zips, ["doc_id", "field"], "left")
    per_field = (
        near.where(given)
        .withColumn("clean", clean)
        .groupBy("doc_id", "field")
        .agg(
            F.coalesce(F.bool_or("_zip"), F.lit(False)).alias("zip"),
            F.max(F.when(own, F.col("clean"))).alias("fused"),
            F.max(F.when(own, F.col("value"))).alias("raw"),
            F.max(F.when(own, F.col("confidence"))).alias("confidence"),
            F.sum((~own & F.col("clean").isNotNull()).cast("int")).alias("valid_others"),
            F.sum((~own & F.col("value").rlike("[0-9]")).cast("int")).alias("numeric_others"),
            F.sum((~own & ~F.col("value").rlike("^[0-9]{4,6}$")).cast("int")).alias("decimal_others"),
        )
    )
    decimals = F.col("raw").rlike(r"[.,][0-9]{2}\b") | F.col("raw").contains("$")
    wins = (
        F.col("field").isin(*forced)
        | (F.col("field").isin("invoice_date", "due_date") & (F.col("valid_others") == 0))
        | (F.col("field").isin("invoice_number", "po_number") & ((F.col("valid_others") == 0) | (F.col("numeric_others") == 0)))
        | ((F.col("field") == "total_amount") & F.col("zip"))
        | ((F.col("field") == "total_amount") & decimals & ((F.col("confidence") >= FOOTER_CONFIDENCE) | (F.col("decimal_others") == 0)))
    )
    return per_field.where(F.col("fused").isNotNull() & wins).select("doc_id", "field", F.col("fused").alias("value"))


def merged_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages (doc_id, page, invoice_number, total) into documents: with one number the
    first page's fields and all items, with several a mark and what the others hold."""
    numbers = F.array_distinct(F.filter(F.array_agg("invoice_number"), lambda n: n != ""))
    first = F.min(F.struct("page", "invoice_number", "total"))
    docs = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.size(numbers).alias("numbers"), first.alias("first")
    )
    counts = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("all_items"), F.count(F.when(F.col("page") == 1, 1)).alias("first_items")
    )
    single = F.col("numbers") == 1
    return docs.join(counts, "doc_id", "left").select(
        "doc_id",
        "pages",
        (~single & (F.col("numbers") > 1)).alias("multiple_invoices"),
        F.col("first.invoice_number").alias("invoice_number"),
        F.col("first.total").alias("total"),
        F.coalesce(F.when(F.col("numbers") <= 1, F.col("all_items")).otherwise(F.col("first_items")), F.lit(0)).alias("line_items"),
    )
