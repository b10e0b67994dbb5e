"""Files as tables: admission, kinds, cells of CSV files, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import first_case

MAX_BYTES = 10 * 1024 * 1024
# Extensions of each kind, and short names of MIME types.
KINDS = {
    "image": ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp"),
    "pdf": ("pdf",),
    "excel": ("xlsx", "xls"),
    "csv": ("csv",),
}
MIME = {
    "application/pdf": "pdf",
    "image/jpeg": "jpeg",
    "image/png": "png",
    "image/tiff": "tiff",
    "text/csv": "csv",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(path: Column) -> Column:
    return first_case([(extension(path).isin(*names), F.lit(k)) for k, names in KINDS.items()], F.lit("unknown"))


def mime_name(mime: Column) -> Column:
    pairs = [F.lit(x) for item in MIME.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(mime)), F.substring(mime, 1, 50))


def rejection(path: Column, size: Column) -> Column:
    """Why a file is not admitted, null if it is: the first test that fails."""
    return first_case(
        [(size > MAX_BYTES, F.lit("too_large")), (size == 0, F.lit("empty")), (kind(path) == "unknown", F.lit("unknown_kind"))],
        F.lit(None).cast("string"),
    )


def upload_id(at: Column, content: Column) -> Column:
    """upload_<time>_<8 hex>: the same for the same content at the same time."""
    return F.concat(F.lit("upload_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha2(content, 256), 1, 8))


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder as documents without their content; a file that cannot
    be taken gets the status FAILED and the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    reason = rejection(F.col("path"), F.col("length"))
    return files.select(
        upload_id(F.col("modificationTime"), F.col("path").cast("binary")).alias("upload_id"),
        "path",
        kind(F.col("path")).alias("kind"),
        F.col("length").alias("size"),
        F.when(reason.isNull(), "UPLOADED").otherwise("FAILED").alias("status"),
        reason.alias("error"),
        F.col("modificationTime").alias("created_at"),
    )


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of CSV files without a header: rows of any width, quoted
    cells that hold commas or line ends. Blank lines are no rows; one task reads a file."""
    whole = spark.read.text(path, wholetext=True)
    bare = F.regexp_replace("value", '"[^"]*"', "")  # without quoted cells, a row is a line
    commas = F.transform(F.split(bare, r"\r?\n"), lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit(""))))
    width = (whole.agg(F.max(F.array_max(commas))).first()[0] or 0) + 1
    schema = ", ".join(f"c{k} string" for k in range(width))
    lines = spark.read.schema(schema).csv(path, multiLine=True, escape='"')
    order = Window.partitionBy("path").orderBy("at")
    rows = lines.select("*", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    cells = F.posexplode(F.array(*[F.col(f"c{k}") for k in range(width)])).alias("col", "value")
    return (
        rows.withColumn("row", F.row_number().over(order) - 1)
        .select("path", "row", cells)
        .where("value is not null")
    )


def reported(df: DataFrame, path: str) -> None:
    """Writes a report as JSON lines."""
    df.write.mode("overwrite").json(path)
