"""Documents that arrive: statuses, vendor state and resolved votes, with checkpoints.

A file sink with a checkpoint takes every document once; state is kept per key
by Spark and survives a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions import text
from fieldloom.operators import consensus, vendors
from fieldloom.sources import files, sinks

_STATE = "vendor_name string, confidence double, invoice_count long, last_seen timestamp"
_VENDOR = f"vendor_fingerprint string, {_STATE}"


def arriving(spark: SparkSession, folder: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def admitted(uploads: DataFrame) -> DataFrame:
    """Uploads (path, size) with kind, status and the reason of a refusal."""
    reason = files.rejection(F.col("path"), F.col("size"))
    return uploads.withColumns(
        {"kind": files.kind(F.col("path")), "error": reason, "status": F.when(reason.isNull(), "PROCESSING").otherwise("FAILED")}
    )


def _vendor_step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    name, best, count, last = state.get if state.exists else (None, -1.0, 0, pd.Timestamp(0))
    for rows in batches:
        top = rows["confidence"].max()
        if top > best:
            first = rows[rows["confidence"] == top].sort_values(["seen_at", "doc_id"]).iloc[0]
            name, best = first["vendor_name"], float(top)
        count += len(rows)
        last = max(pd.Timestamp(last), rows["seen_at"].max())
    state.update((name, best, count, last))
    yield pd.DataFrame({"vendor_fingerprint": [key[0]], "vendor_name": [name], "confidence": [best], "invoice_count": [count], "last_seen": [last]})


def vendor_states(documents: DataFrame) -> DataFrame:
    """The running state of each vendor: a strictly greater confidence renames it.

    All rows that a batch has of a vendor meet in one group; :func:`vendors_to` has none such."""
    keyed = documents.withColumn("vendor_fingerprint", text.fingerprint(F.col("vendor_name"))).where("vendor_fingerprint is not null and confidence >= 10")
    return keyed.groupBy("vendor_fingerprint").applyInPandasWithState(_vendor_step, _VENDOR, _STATE, "update", "NoTimeout")


def resolved_to(votes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Resolves each batch of whole documents' votes and appends to a folder.

    A batch has a folder of its own that a repeated run overwrites, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        consensus.field_vote(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return votes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vendors_to(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of vendors (see ``sources.sinks``) up to date with documents that arrive.

    A batch is reduced to its distinct names before vendors meet, so a vendor with many
    documents is no hot group, and a batch that is run again is applied once."""

    def write(batch: DataFrame, number: int) -> None:
        empty = batch.sparkSession.createDataFrame([], f"{_VENDOR.replace('long', 'int')}")
        sinks.changed(batch.sparkSession, path, lambda old: vendors.upserted(empty if old is None else old, batch), number)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
