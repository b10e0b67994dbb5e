"""Submitted corrections as one plan: anchors, the corrected record, what is recorded and what templates learn.

A submission is (doc_id, corrected: map by field, boxes and pages: maps of what the reviewer
marked, submitted_at). A field without a box is anchored at the first token of the document
that equals its value, lies in it or holds it. A document's values stand in one row, as they
were submitted; its tokens are streamed past them, so no pair of them is a row unless it
matches. Joins by document shuffle both sides: tokens are many times the size of the files
that they are derived from, so a size estimated from files must not make them a broadcast.

Cases: blank and null values and tokens match nothing; of several submissions for one document the last counts, of
equal times the one whose fields sort last; a document without tokens or vendor is corrected
all the same, and teaches nothing without a vendor; submissions for unknown documents are
reported by :func:`unknown` and change nothing; a page without extent gives no box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import vote_key
from fieldloom.operators import templates

#: The confidence of a value that a person gave.
REVIEWED = 100.0


def containing(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs of values (doc_id, field, value) and tokens (doc_id, ..., text) of a document of which one holds the other, each once."""
    own = values.withColumn("_value", vote_key(F.col("value"))).where("_value <> ''")
    kept = [c for c in values.columns if c != "doc_id"]
    by_doc = own.groupBy("doc_id").agg(F.collect_list(F.struct("_value", *kept)).alias("_values"))
    near = tokens.withColumn("_token", vote_key(F.col("text"))).where("_token <> ''")
    met = near.join(by_doc.hint("merge"), "doc_id")
    token = F.col("_token")
    held = F.filter("_values", lambda v: v["_value"].contains(token) | token.contains(v["_value"]))
    return met.select("doc_id", *[c for c in tokens.columns if c != "doc_id"], F.explode(held).alias("_v")).select(
        "*", *[F.col(f"_v.{c}").alias(c) for c in kept]
    ).drop("_v")


def latest(submissions: DataFrame) -> DataFrame:
    """One submission of each document."""
    fields = F.array_sort(F.map_entries("corrected"))
    order = Window.partitionBy("doc_id").orderBy(F.col("submitted_at").desc_nulls_last(), fields.desc())
    return submissions.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def anchors(submissions: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, field, bbox, page): the reviewer's box of each field, else that of its first token, as shares of the page."""
    fields = submissions.select("doc_id", "boxes", "pages", F.explode("corrected").alias("field", "value"))
    marked = fields.select("doc_id", "field", "value", F.try_element_at("boxes", F.col("field")).alias("bbox"), F.try_element_at("pages", F.col("field")).alias("page"))
    wanted = marked.where("bbox is null")
    met = containing(wanted.select("doc_id", "field", "value"), tokens)
    first = met.groupBy("doc_id", "field").agg(F.min(F.struct("source", "page", "tok_no", "x0", "y0", "x1", "y1")).alias("t"))
    # the pages of submitted documents only; both sides are dealt by document already
    extent = tokens.join(submissions.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").groupBy("doc_id", "page", "source").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    sided = first.select("doc_id", "field", "t.*").join(extent.hint("merge"), ["doc_id", "page", "source"])
    share = lambda c, side: F.col(c) / F.nullif(F.col(side), F.lit(0))
    found = sided.select(
        "doc_id", "field", F.array(share("x0", "width"), share("y0", "height"), share("x1", "width"), share("y1", "height")).alias("bbox"), "page"
    )
    return marked.where("bbox is not null").select("doc_id", "field", "bbox", "page").unionByName(found)


def unknown(submissions: DataFrame, documents: DataFrame) -> DataFrame:
    return submissions.join(documents.select("doc_id"), "doc_id", "left_anti")


def submitted(submissions: DataFrame, documents: DataFrame, tokens: DataFrame, template: DataFrame) -> dict[str, DataFrame]:
    """What submissions make of documents (doc_id, vendor_id, extracted_data, status), their
    tokens and the templates: the tables ``documents``, ``corrections`` and ``template``."""
    last = latest(submissions)
    joined = documents.join(last.select("doc_id", "corrected", "submitted_at").hint("merge"), "doc_id", "left")
    given = F.col("corrected").isNotNull()
    record = joined.select(
        "doc_id",
        "vendor_id",
        F.when(given, F.col("corrected")).otherwise(F.col("extracted_data")).alias("extracted_data"),
        F.when(given, "CORRECTED").otherwise(F.col("status")).alias("status"),
    )
    changed = joined.where(given)
    rows = templates.recorded(changed.select("doc_id", "vendor_id", "extracted_data", "corrected", "submitted_at"), F.col("submitted_at"))
    places = anchors(last, tokens).withColumnRenamed("field", "field_name")
    corrections = rows.join(places.hint("merge"), ["doc_id", "field_name"], "left")
    fields = changed.where("vendor_id is not null").select("vendor_id", "submitted_at", F.explode("corrected").alias("field", "value"))
    learned = templates.learned(template, fields.select("vendor_id", "field", "value", F.lit(REVIEWED).alias("confidence"), F.col("submitted_at").alias("seen")))
    return {"documents": record, "corrections": corrections, "template": learned}
