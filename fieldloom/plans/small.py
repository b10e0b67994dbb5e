"""Token structs, confidences of producers and scalar rules that no larger query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates, text
from fieldloom.operators import scan
from fieldloom.plans.sql import DOCUMENTS
from fieldloom.plans import render
from fieldloom.session import table
from fieldloom.sources import files


def token_structs(spark: SparkSession, folder: str) -> DataFrame:
    """Words of rendered documents as parallel arrays, some blank, without a box or on a page without a size."""
    k = F.col("doc_id")
    words = render.documents(spark, folder).select("doc_id", F.concat(F.split("text", r"\s"), F.array(F.lit(" "))).alias("text"))
    n = F.sequence(F.lit(0), F.size("text") - 1)
    pages = words.select(
        "doc_id", F.lit(1).alias("page"), "text", F.transform(n, lambda i: F.when(i % 4 != 3, (i * 10).cast("string")).otherwise("x")).alias("conf"), F.transform(n, lambda i: i * 40).alias("left"),
        F.transform(n, lambda i: F.when(i != 2, i + 5)).alias("top"), F.transform("text", lambda w: F.length(w) * 8).alias("width"), F.transform(n, lambda i: F.lit(12)).alias("height"),
        F.when(k % 3 == 0, 0).otherwise(1000).alias("page_width"), F.lit(800).alias("page_height"),
    )
    box = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.8f", x.cast("double"))), ",")
    return scan.token_structs(pages).select("doc_id", "tok_no", "text", "conf", box("bbox_px").alias("bbox_px"), box("bbox").alias("bbox"))


def producer_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Confidences of records with two to five fields, what they lack, and the answers' mean."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"))
    k = F.col("doc_id")
    record = F.create_map(F.lit("vendor_name"), F.when(k % 2 == 0, "V"), F.lit("invoice_number"), F.when(k % 3 == 0, " ").otherwise(F.lit("N")), F.lit("currency"), F.lit("USD"), F.lit("total_amount"), F.when(k % 5 == 0, "1"))
    scores = orders.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.pmod(k * n, F.lit(m)) / 20).alias("score")) for f, n, m in (("a", 3, 20), ("a", 7, 19), ("customer_name", 5, 11))])).alias("s")).select("doc_id", "s.*")
    rows = orders.select(
        "doc_id", scan.visual_confidence(record).alias("visual"), F.array_join(scan.missing(record, ("vendor_name", "invoice_number", "total_amount")), ",").alias("missing"),
        scan.template_match(F.transform(F.slice(F.array(F.lit(80.0), F.lit(90.0)), F.lit(1), (k % 3).cast("int")), lambda c: c + k % 7)).alias("template"),
        F.array_join(scan.setting_list(F.concat(F.lit(" a,, b "), F.when(k % 2 == 0, ", ").otherwise(",c"))), "|").alias("setting"),
    )
    return rows.join(scan.answer_confidence(scores), "doc_id")


def scalar_rest(spark: SparkSession, folder: str) -> DataFrame:
    """Token keys, cleaned vendors, currencies, durations, sizes, dates that lie ahead and short names of types."""
    k, date = F.col("doc_id"), F.col("date_text")
    docs = render.documents(spark, folder).join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id")
    vendor = F.when(k % 4 == 0, F.concat(F.lit("## Acme  "), k.cast("string"))).when(k % 4 == 1, "9A").when(k % 4 == 2, "Bill To Acme").otherwise("Acme  Works")
    return docs.select(
        "doc_id", text.token_key(F.col("amount_text")).alias("token_key"), text.vendor_clean(vendor).alias("vendor"), text.currency_of(F.col("amount_text")).alias("currency"),
        text.truncated(date, 7).alias("truncated"), text.file_size((k * 997) % 3000).alias("size"), dates.duration((k * 331) % 2000 * 100 + k % 7).alias("duration"),
        dates.date_token(F.element_at(F.split("text", r"\s"), -1)).alias("last_is_date"), dates.not_future(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1998-06-01").cast("timestamp")).alias("past"),
        files.mime_name(F.when(k % 2 == 0, "Image/PNG").otherwise("application/x-unknown")).alias("mime"),
    )


QUERIES = {f.__name__: f for f in (token_structs, producer_confidence, scalar_rest)}

ORACLES = {
    "token_structs": f"""WITH {DOCUMENTS}, w AS (SELECT doc_id, regexp_split_to_array(text, '\\s') AS ws FROM docs), e AS (SELECT doc_id, unnest(list_append(ws, ' ')) AS word, generate_subscripts(list_append(ws, ' '), 1) - 1 AS i FROM w)
      SELECT doc_id, i :: INT AS tok_no, word AS text, CASE WHEN i % 4 <> 3 THEN i * 10 END :: DOUBLE AS conf, printf('%.8f,%.8f,%.8f,%.8f', i * 40.0, i + 5.0, i * 40.0 + length(word) * 8.0, i + 17.0) AS bbox_px,
        CASE WHEN doc_id % 3 <> 0 THEN printf('%.8f,%.8f,%.8f,%.8f', i * 40 / 1000.0 :: DOUBLE, (i + 5) / 800.0 :: DOUBLE, (i * 40 + length(word) * 8) / 1000.0 :: DOUBLE, (i + 17) / 800.0 :: DOUBLE) END AS bbox
      FROM e WHERE trim(word) <> '' AND i <> 2""",
    "producer_confidence": """WITH s AS (SELECT o_orderkey AS k, greatest((o_orderkey * 3 % 20) / 20.0 :: DOUBLE, (o_orderkey * 7 % 19) / 20.0 :: DOUBLE) AS a, (o_orderkey * 5 % 11) / 20.0 :: DOUBLE AS b FROM orders)
      SELECT k AS doc_id, least(100.0, ((k % 2 = 0) :: INT + 1 + (k % 5 = 0) :: INT) / 4.0 * 100 + CASE WHEN k % 2 = 0 THEN 5 ELSE 0 END + 5 + CASE WHEN k % 5 = 0 THEN 10 ELSE 0 END) :: DOUBLE AS visual,
        concat_ws(',', CASE WHEN k % 2 <> 0 THEN 'vendor_name' END, CASE WHEN k % 3 = 0 THEN 'invoice_number' END, CASE WHEN k % 5 <> 0 THEN 'total_amount' END) AS missing,
        CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 80 + k % 7 ELSE 85 + k % 7 END :: DOUBLE AS template, CASE WHEN k % 2 = 0 THEN 'a|b' ELSE 'a|b|c' END AS setting, round((a + b) / 2 * 100, 2) AS confidence FROM s""",
    "scalar_rest": f"""WITH {DOCUMENTS}, m AS (SELECT *, doc_id * 331 % 2000 * 100 + doc_id % 7 AS ms FROM docs) SELECT doc_id, regexp_replace(lower(amount_text), '[^a-z0-9#]', '', 'g') AS token_key, CASE doc_id % 4 WHEN 0 THEN ' Acme ' || doc_id WHEN 3 THEN 'Acme Works' END AS vendor, 'USD' AS currency,
        CASE WHEN length(date_text) > 7 THEN left(date_text, 7) || '...' ELSE date_text END AS truncated,
        CASE WHEN doc_id * 997 % 3000 = 0 THEN '0 Bytes' WHEN doc_id * 997 % 3000 < 1024 THEN (doc_id * 997 % 3000) || ' Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round((doc_id * 997 % 3000) / 1024.0 :: DOUBLE, 2)), '0+$', ''), '\\.$', '') || ' KB' END AS size,
        CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000.0 :: DOUBLE) || 's' ELSE (ms // 60000) || 'm ' || (ms // 1000 % 60) || 's' END AS duration,
        true AS last_is_date, o_orderdate :: DATE <= DATE '1998-06-01' AS past, CASE WHEN doc_id % 2 = 0 THEN 'png' ELSE 'application/x-unknown' END AS mime FROM m JOIN orders ON doc_id = o_orderkey""",
}
