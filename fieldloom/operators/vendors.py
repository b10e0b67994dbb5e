"""Vendors: resolution by fingerprint, upsert, statistics and sequence gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text

LEAST_CONFIDENCE = 10


def fingerprints(documents: DataFrame) -> DataFrame:
    """vendor_name, its key and fingerprint: the rules run once for each distinct name."""
    name = F.col("vendor_name")
    return documents.select(name).distinct().select(
        name, text.vendor_key(name).alias("vendor_name_normalized"), text.fingerprint(name).alias("vendor_fingerprint")
    )


def _usable(documents: DataFrame) -> DataFrame:
    """Without a name or below the least confidence there is no sighting."""
    return documents.where((F.col("confidence") >= LEAST_CONFIDENCE) & (F.coalesce("vendor_name", F.lit("")) != ""))


def _named(by_name: DataFrame) -> DataFrame:
    """Aggregates of each distinct name with the name's fingerprint: the rules run once for each."""
    return by_name.withColumn("vendor_fingerprint", text.fingerprint(F.col("vendor_name")))


def matched(documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """Documents with the vendor of their fingerprint, if there is one."""
    own = vendors.select("vendor_fingerprint", F.col("id").alias("vendor_id"))
    named = fingerprints(documents).select("vendor_name", "vendor_fingerprint").join(own, "vendor_fingerprint", "left")
    return documents.join(named, "vendor_name", "left")


def unknown(documents: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row for each fingerprint that no vendor has."""
    by_name = _usable(documents).groupBy("vendor_name").agg(F.min(F.struct("seen_at", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    found = _named(by_name).groupBy("vendor_fingerprint").agg(
        F.min_by("vendor_name", "first").alias("vendor_name"), F.sum("n").alias("documents"), F.count("vendor_fingerprint").alias("names")
    )
    # a test of the count, as one of the fingerprint would be pushed below the aggregation of rows
    return found.where("names > 0").drop("names").join(vendors.select("vendor_fingerprint"), "vendor_fingerprint", "left_anti")


def state(documents: DataFrame) -> DataFrame:
    """What a vendor's row becomes after its documents in order of time: the count,
    the last time, and the name of the first most confident sighting."""
    order = F.struct((-F.col("confidence")).alias("c"), "seen_at", "doc_id")
    by_name = _usable(documents).groupBy("vendor_name").agg(
        F.min(order).alias("best"), F.count(F.lit(1)).alias("n"), F.max("seen_at").alias("last_seen")
    )
    found = _named(by_name).groupBy("vendor_fingerprint").agg(
        F.min_by("vendor_name", "best").alias("vendor_name"),
        (-F.min("best")["c"]).alias("confidence"),
        F.sum("n").cast("int").alias("invoice_count"),
        F.max("last_seen").alias("last_seen"),
        F.count("vendor_fingerprint").alias("names"),
    )
    return found.where("names > 0").drop("names")


def upserted(vendors: DataFrame, documents: DataFrame) -> DataFrame:
    """The vendors table after a batch: counts add up, a strictly greater confidence renames."""
    new = state(documents)
    old = vendors.select("vendor_fingerprint", *[F.col(c).alias(f"old_{c}") for c in ("vendor_name", "confidence", "invoice_count", "last_seen")])
    both = old.join(new, "vendor_fingerprint", "full_outer")
    better = F.coalesce(F.col("confidence") > F.col("old_confidence"), F.col("old_confidence").isNull())
    return both.select(
        "vendor_fingerprint",
        F.when(better, F.col("vendor_name")).otherwise(F.col("old_vendor_name")).alias("vendor_name"),
        F.when(better, F.col("confidence")).otherwise(F.col("old_confidence")).alias("confidence"),
        (F.coalesce("invoice_count", F.lit(0)) + F.coalesce("old_invoice_count", F.lit(0))).alias("invoice_count"),
        F.greatest("last_seen", "old_last_seen").alias("last_seen"),
    )


def statistics(vendors: DataFrame, documents: DataFrame) -> DataFrame:
    """Every vendor's number of documents and mean overall confidence."""
    counts = documents.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("overall_confidence"), 2).alias("average_confidence")
    )
    return vendors.select("vendor_id", "vendor_name").join(counts, "vendor_id", "left").fillna({"documents": 0})


def sequence_gaps(documents: DataFrame, limit: int = 1000) -> DataFrame:
    """Each document's number against the one before of its vendor: decreased, large gap, or null."""
    order = Window.partitionBy("vendor_id").orderBy("invoice_date", "doc_id")
    step = F.col("last_number") - F.lag("last_number").over(order)
    return documents.withColumn("last_number", text.last_number(F.col("invoice_number"))).select(
        "doc_id", "vendor_id", step.alias("step"), F.when(step < 0, "decreased").when(step > limit, "large_gap").alias("warning")
    )
