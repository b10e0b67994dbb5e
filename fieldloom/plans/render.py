"""Documents, votes, tokens and corrections that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.session import table

VOTERS = ("docling", "impira", "layoutlm", "donut", "ocr_rapid", "ocr_fused")


def votes(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Up to six voters' readings of four fields of every order; ``dealt``: orders are dealt before they become votes, which then lie by document."""
    voters = F.explode(F.array(*[F.struct(F.lit(v).alias("voter"), F.lit(k).alias("voter_ord")) for k, v in enumerate(VOTERS)]))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    base = (
        (orders.repartition("o_orderkey") if dealt else orders)
        .select(F.col("o_orderkey").alias("k"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.date_format("o_orderdate", "yyyy").alias("year"), voters.alias("v"))
        .select("k", "o_custkey", "cents", "year", "v.voter", F.col("v.voter_ord").alias("o"))
        .where("(k + o) % 7 <> 0")
    )
    cents = F.col("cents")
    fields = {
        "total_amount": (cents + F.when((F.col("k") * 3 + F.col("o")) % 4 == 0, 1).otherwise(0)).cast("string"),
        "invoice_number": F.concat(
            F.when((F.col("k") + F.col("o")) % 3 == 0, "inv-").otherwise("INV-"), F.col("year"), F.lit("-"), F.col("k").cast("string")
        ),
        "vendor_name": F.concat(F.when((F.col("k") + F.col("o")) % 5 < 2, "Supplier ").otherwise("SUPPLIER   "), (F.col("o_custkey") + (F.col("k") + F.col("o")) % 2).cast("string")),
        "currency": F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("usd")), ((F.col("k") + F.col("o")) % 3 + 1).cast("int")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()]))
    return base.select(
        F.col("k").alias("doc_id"),
        "voter",
        F.col("o").alias("voter_ord"),
        (F.lit(60) + (F.col("k") * 7 + F.col("o") * 13) % 40).cast("double").alias("confidence"),
        rows.alias("r"),
    ).select("doc_id", "voter", "voter_ord", "r.field", "r.value", "confidence")


def amount_text(cents, k):
    """An amount of whole cents in one of four written forms."""
    units, rest = F.floor(cents / 100).cast("long"), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0")
    high, low = F.floor(units / 1000).cast("long"), F.lpad((units % 1000).cast("string"), 3, "0")
    split = lambda mark: F.when(high > 0, F.concat(high.cast("string"), F.lit(mark), low)).otherwise(units.cast("string"))
    return (
        F.when(k % 4 == 0, F.concat(F.lit("$"), split(","), F.lit("."), rest))
        .when(k % 4 == 1, F.concat(split("."), F.lit(","), rest))
        .when(k % 4 == 2, F.concat(units.cast("string"), F.lit("."), rest))
        .otherwise(F.concat(units.cast("string"), F.lit(","), rest))
    )


def date_text(date, k):
    """A date in one of five written forms."""
    return (
        F.when(k % 5 == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(k % 5 == 1, F.date_format(date, "MM/dd/yyyy"))
        .when(k % 5 == 2, F.date_format(date, "dd.MM.yyyy"))
        .when(k % 5 == 3, F.date_format(date, "MMMM d, yyyy"))
        .otherwise(F.date_format(date, "d MMM yyyy"))
    )


def documents(spark: SparkSession, folder: str, of_task: int | None = None) -> DataFrame:
    """doc_id, text, amount_text, date_text, cents: one rendered document per order; with
    ``of_task`` orders are dealt before they become documents, to as many tasks as leave each about so many."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if of_task is not None:
        orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-orders.count() // of_task)), "o_orderkey")
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    kind = F.when(k % 11 == 0, "Credit Note").when(k % 7 == 0, "Quotation").when(k % 5 == 0, "Statement").otherwise("Invoice")
    return (
        orders.select(
            k.alias("doc_id"),
            amount_text(cents, k).alias("amount_text"),
            date_text(F.col("o_orderdate"), k).alias("date_text"),
            cents.alias("cents"),
            kind.alias("kind"),
            F.date_format("o_orderdate", "yyyy").alias("year"),
            "o_custkey",
        )
        .withColumn(
            "text",
            F.concat_ws(
                "\n",
                F.col("kind"),
                F.concat(F.lit("Invoice No: INV-"), F.col("year"), F.lit("-"), F.col("doc_id").cast("string")),
                F.concat(F.lit("Date: "), F.col("date_text")),
                F.concat(F.lit("Vendor: Northern Trading "), F.col("o_custkey").cast("string")),
                F.concat(F.lit("TOTAL: "), F.col("amount_text")),
            ),
        )
        .select("doc_id", "text", "amount_text", "date_text", "cents")
    )


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Corrections of vendor fields from ``events``."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("vendor_id"),
        F.col("event_type").alias("field_name"),
        F.format_string("%.2f", F.coalesce(F.round("value", 2), F.lit(0.0))).alias("corrected_value"),
        F.array(*[(F.pmod(F.col("event_id") * n, F.lit(100)) / 100.0) for n in (3, 5, 7, 11)]).alias("bbox"),
        (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("page_number"),
        F.col("ts").alias("created_at"),
    )


def tokens(spark: SparkSession, folder: str, of_task: int | None = None) -> DataFrame:
    """Words of the rendered documents with boxes from their line and place; ``of_task`` as above, words then lie by document."""
    return tokens_of(documents(spark, folder, of_task))


def tokens_of(docs: DataFrame) -> DataFrame:
    """Words of documents (doc_id, text), as above."""
    words = (
        docs
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
        .select("doc_id", "line", F.posexplode(F.split("content", " ")).alias("place", "text"))
    )
    x0 = F.col("place") * 90 + 20
    y0 = F.col("line") * 30 + 10 + F.pmod(F.col("doc_id") + F.col("place"), F.lit(3)).cast("int")
    return words.select(
        "doc_id",
        F.lit(1).alias("page"),
        F.lit("tesseract_v3").alias("source"),
        (F.col("line") * 20 + F.col("place")).alias("tok_no"),
        "text",
        (F.lit(0.6) + F.pmod(F.col("doc_id") + F.col("place"), F.lit(4)) / 10.0).alias("conf"),
        x0.cast("int").alias("x0"),
        y0.cast("int").alias("y0"),
        (x0 + F.length("text") * 8).cast("int").alias("x1"),
        (y0 + 12).cast("int").alias("y1"),
        "line",
    )
