"""Serving: status, detail, lists and statistics of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROGRESS = {"UPLOADED": 10, "PROCESSING": 50, "EXTRACTED": 100, "FAILED": 0}


def progress(status: Column) -> Column:
    pairs = [F.lit(x) for item in PROGRESS.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit(0))


def listed(documents: DataFrame, page: int = 1, limit: int = 20, status: str | None = None, vendor_name: str | None = None,
           date_from: str | None = None, date_to: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """One page of the documents that meet every given condition, newest first."""
    tests = (
        (status, F.col("status") == status),
        (vendor_name, F.lower("vendor_name").contains((vendor_name or "").lower())),
        (date_from, F.col("invoice_date") >= F.lit(date_from)),
        (date_to, F.col("invoice_date") <= F.lit(date_to)),
        (min_confidence, F.col("overall_confidence") >= F.lit(min_confidence)),
    )
    for given, test in tests:
        if given is not None:
            documents = documents.where(test)
    return documents.orderBy(F.col("invoice_date").desc(), "doc_id").offset((page - 1) * limit).limit(limit)


def page_count(documents: DataFrame, limit: int = 20) -> DataFrame:
    n = F.count(F.lit(1))
    return documents.agg(n.alias("total"), F.ceil(n / limit).alias("pages"))


def statistics(documents: DataFrame) -> DataFrame:
    """Counts by state, and the mean confidence with all rows as its denominator."""
    count = lambda *states: F.sum(F.col("status").isin(*states).cast("int"))
    return documents.agg(
        F.count(F.lit(1)).alias("total"),
        count("EXTRACTED", "APPROVED").alias("processed"),
        count("PROCESSING", "UPLOADED").alias("pending"),
        count("FAILED").alias("failed"),
        F.round(F.sum(F.coalesce("overall_confidence", F.lit(0.0))) / F.count(F.lit(1)), 2).alias("average_confidence"),
    )


def detail(documents: DataFrame) -> DataFrame:
    """Documents with their public fields; keys that begin with _ are internal."""
    public = F.map_filter("extracted_data", lambda k, v: ~k.startswith("_"))
    internal = F.map_filter("extracted_data", lambda k, v: k.startswith("_"))
    return documents.withColumns({"fields": public, "internal": internal, "progress": progress(F.col("status"))})


def corrected(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with the newest correction of each field over the extracted one, and status CORRECTED."""
    newest = Window.partitionBy("doc_id", "field_name").orderBy(F.col("created_at").desc(), F.col("id").desc())
    last = (
        corrections.withColumn("place", F.row_number().over(newest))
        .where("place = 1")
        .groupBy("doc_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field_name", "corrected_value"))).alias("_new"))
    )
    old = F.map_filter("extracted_data", lambda k, v: ~F.map_contains_key("_new", k))
    return (
        documents.join(last, "doc_id", "left")
        .withColumn("extracted_data", F.when(F.col("_new").isNotNull(), F.map_concat(old, "_new")).otherwise(F.col("extracted_data")))
        .withColumn("status", F.when(F.col("_new").isNotNull(), "CORRECTED").otherwise(F.col("status")))
        .drop("_new")
    )
