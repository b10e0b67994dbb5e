"""Files of mixed kinds dealt into typed tables and a table of failures.

Contents are read once, and only of files whose name and size are admitted; a file becomes
one row with its route: ``csv`` (cells), ``json`` (records, one an object or a line), ``text``,
``binary`` (known by its signature, for decoders elsewhere) or ``failed`` with a reason. One
write deals the rows by route; the typed tables are that folder, unfolded. A file that cannot
be read spoils only its own row.

Cases: blank CSV lines are no rows; text must be UTF-8; a byte order mark is dropped; a JSON
value that is no object or list of objects fails; nested JSON values stay JSON text; an empty
folder gives empty tables.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldloom.functions.text import first_case
from fieldloom.sources.files import MAX_BYTES, extension, upload_id

#: Routes by extension and signatures by extension.
ROUTES = {
    "csv": ("csv",),
    "json": ("json", "jsonl"),
    "text": ("txt", "text", "html", "htm", "md"),
    "binary": ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "xlsx", "xls"),
}
SIGNATURES = {
    "pdf": (b"%PDF",), "png": (b"\x89PNG\r\n\x1a\n",), "jpg": (b"\xff\xd8\xff",), "jpeg": (b"\xff\xd8\xff",), "tif": (b"II*\x00", b"MM\x00*"),
    "tiff": (b"II*\x00", b"MM\x00*"), "bmp": (b"BM",), "webp": (b"RIFF",), "xlsx": (b"PK\x03\x04",), "xls": (b"\xd0\xcf\x11\xe0",),
}
FILE = "path string, modificationTime timestamp, length long, content binary"
_CELLS = "array<struct<row:int,col:int,value:string>>"
_RECORDS = "array<map<string,string>>"
SCHEMA = f"upload_id string, path string, size long, created_at timestamp, route string, reason string, text string, cells {_CELLS}, records {_RECORDS}"


def route_of(path) -> F.Column:
    return first_case([(extension(path).isin(*names), F.lit(r)) for r, names in ROUTES.items()], F.lit(None).cast("string"))


def read_cells(text: str) -> list[dict]:
    rows = csv.reader(io.StringIO(text, newline=""), strict=True)
    return [{"row": r, "col": c, "value": v} for r, row in enumerate(x for x in rows if x) for c, v in enumerate(row)]


def read_records(text: str) -> list[dict]:
    try:
        whole = json.loads(text)
    except ValueError:
        whole = [json.loads(line) for line in text.splitlines() if line.strip()]
    every = whole if isinstance(whole, list) else [whole]
    if not every or not all(isinstance(x, dict) for x in every):
        raise ValueError("no object")
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)
    return [{k: plain(v) for k, v in x.items()} for x in every]


def read(route: str, ending: str, content: bytes) -> tuple[str | None, str | None, list | None, list | None]:
    """(reason, text, cells, records) of one file."""
    if route == "binary":
        return (None if content.startswith(SIGNATURES[ending]) else "bad_signature"), None, None, None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return "not_utf8", None, None, None
    try:
        if route == "csv":
            return None, None, read_cells(text), None
        if route == "json":
            return None, None, None, read_records(text)
    except (ValueError, csv.Error, RecursionError):
        return f"bad_{route}", None, None, None
    return None, text, None, None


def _parsed(admitted: DataFrame) -> DataFrame:
    kinds = {
        "cells": pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("value", pa.string())])),
        "records": pa.list_(pa.map_(pa.string(), pa.string())),
    }
    keep = ["upload_id", "path", "size", "created_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one file a batch, as contents may be large
                route, ending, content = (b.column(c)[k].as_py() for c in ("route", "ending", "content"))
                reason, text, cells, records = read(route, ending, content or b"")
                values = [pa.array(["failed" if reason else route], pa.string()), pa.array([reason], pa.string()), pa.array([text], pa.string())]
                listed = [pa.array([cells], kinds["cells"]), pa.array([None if records is None else [list(r.items()) for r in records]], kinds["records"])]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).slice(k, 1) for c in keep], *values, *listed], [*keep, "route", "reason", "text", "cells", "records"]
                )

    return admitted.mapInArrow(run, SCHEMA)


def routed(files: DataFrame) -> DataFrame:
    """Every file (path, modificationTime, length, content) as one row of ``SCHEMA``."""
    named = files.select(
        upload_id(F.col("modificationTime"), F.col("path").cast("binary")).alias("upload_id"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("created_at"),
        route_of(F.col("path")).alias("route"),
        extension(F.col("path")).alias("ending"),
        *([F.col("content")] if "content" in files.columns else []),
    )
    reason = first_case(
        [(F.col("size") > MAX_BYTES, F.lit("too_large")), (F.coalesce("size", F.lit(0)) == 0, F.lit("empty")), (F.col("route").isNull(), F.lit("unknown_kind"))],
        F.lit(None).cast("string"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    # the content of files that are not admitted is never asked for
    refused = named.drop("content").withColumn("reason", reason).where("reason is not null").select(
        "upload_id", "path", "size", "created_at", F.lit("failed").alias("route"), "reason", none("string").alias("text"), none(_CELLS).alias("cells"), none(_RECORDS).alias("records")
    )
    admitted = named.where(f"size between 1 and {MAX_BYTES} and route is not null")
    return _parsed(admitted).unionByName(refused) if "content" in files.columns else refused


def empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of files without content, which Spark's file sources pass over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, listed = [], where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while listed.hasNext():
        file = listed.next()
        if file.getLen() == 0:
            found.append((file.getPath().toString(), file.getModificationTime()))
    return spark.createDataFrame(found, "path string, ms long").select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"))


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder; those without content have a null one."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return held.unionByName(empty_files(spark, folder), allowMissingColumns=True)


def dealt(rows: DataFrame, out: str) -> None:
    """Writes routed rows once, dealt by route; a repeated write replaces its own folder."""
    rows.write.mode("overwrite").partitionBy("route").parquet(out)


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The typed tables of what :func:`dealt` or :func:`arriving` wrote."""
    schema = SCHEMA.replace(", route string", "")
    rows = spark.read.schema(f"{schema}, route string").option("recursiveFileLookup", "false").parquet(out)
    of = lambda r: rows.where(F.col("route") == r)
    return {
        "csv": of("csv").select("upload_id", "path", F.explode("cells").alias("c")).select("upload_id", "path", "c.*"),
        "json": of("json").select("upload_id", "path", F.posexplode("records").alias("record_no", "record")),
        "text": of("text").select("upload_id", "path", "text"),
        "binary": of("binary").select("upload_id", "path", "size"),
        "failed": of("failed").select("upload_id", "path", "size", "reason"),
        "files": rows.select("upload_id", "path", "size", "created_at", "route", F.when(F.col("route") == "failed", "FAILED").otherwise("UPLOADED").alias("status"), "reason"),
    }


def arriving(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Files that arrive in a folder, each dealt once; a batch that is run again replaces its own
    folder, and each run that of the files that are still empty."""
    dealt(routed(empty_files(spark, folder)), f"{out}/batch=-1")
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        dealt(routed(batch), f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
