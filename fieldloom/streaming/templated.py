"""Votes that arrive, resolved with the templates of their vendors as corrections stand then.

Every batch reads the corrections again, rebuilds the templates of the vendors that it
holds, and lets a template vote beside the batch's own voters where its vendor is known and
the field was corrected often enough. Only corrections made no later than the batch's newest
document count, so a batch that is run again after a failure sees the corrections that it
saw, and its folder is overwritten: every document counts once.

Cases: documents of an unknown vendor, of one without corrections or with too few are
resolved from their own votes; a missing or empty corrections table is no templates; a null
time of arrival sees all corrections; an empty batch writes an empty folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.operators import consensus, templates

TEMPLATE_ORDER = 100
VOTE = ["doc_id", "voter", "voter_ord", "field", "value", "confidence"]


def with_templates(votes: DataFrame, corrections: DataFrame, least: int = 1, confidence: float = 85.0) -> DataFrame:
    """Votes (doc_id, vendor_id, arrived_at and those of a field vote) with those of templates.

    Corrections are cut to the vendors at hand before they are grouped; the newest arrival is
    one row by construction, so it is broadcast."""
    documents = votes.select("doc_id", "vendor_id").where("vendor_id is not null").distinct()
    upto = votes.agg(F.max("arrived_at").alias("upto"))
    known = votes.select("vendor_id").distinct()  # of votes, not of documents, which would be dealt once more for it
    seen = corrections.join(known, "vendor_id", "left_semi").join(F.broadcast(upto), F.col("upto").isNull() | (F.col("created_at") <= F.col("upto"))).drop("upto")
    template = templates.rebuilt(seen).where(F.col("occurrences") >= least)
    voted = templates.voter(documents, template, TEMPLATE_ORDER, confidence)
    # few beside the votes, and dealt like these, so that votes that lie by document need not move
    return votes.select(*VOTE).unionByName(voted.select(*VOTE).repartition("doc_id"))


def records(votes: DataFrame, corrections: DataFrame, least: int = 1, confidence: float = 85.0, dealt: list[str] | None = consensus.DOCUMENT) -> DataFrame:
    """(doc_id, field, value, confidence, agreement, template_applied) of every field of the votes, templates included;
    ``dealt`` as of a field vote."""
    every = with_templates(votes, corrections, least, confidence)
    applied = F.array_contains("selected_from", "ocr_template").alias("template_applied")
    return consensus.field_vote(every, dealt).select("doc_id", "field", "value", "confidence", "agreement", applied)


def resolved_with_templates(votes: DataFrame, corrections_at: str, corrections_schema: str, out: str, checkpoint: str, least: int = 1) -> StreamingQuery:
    """Resolves each batch with the corrections that lie in a folder by then."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(corrections_schema).parquet(corrections_at)
        batch.persist()
        try:
            records(batch, held, least).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            batch.unpersist()

    return votes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
