"""Queries of the quality, label and table operators, and of recorded corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import labels, quality, serve
from fieldloom.plans import render
from fieldloom.plans.sql import CORRECTIONS, DOCUMENTS
from fieldloom.session import table


def image_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics derived from parts, counted by what is wrong."""
    k = F.col("p_partkey")
    codes = quality.quality_codes(500 + k % 700, 400 + k % 900, 100 + k % 200, 50.0 + k % 150, 10.0 + k % 60, k % 256)
    return table(spark, folder, "part").select(F.array_join(codes, ",").alias("codes")).groupBy("codes").agg(F.count(F.lit(1)).alias("images"))


def page_geometry(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    g = quality.geometry(1000 + k % 1500, 1400 + k % 2100, F.when(k % 4 == 0, 200), k % 3 == 0)
    return table(spark, folder, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.paper", "g.dpi", "g.scale")


def weighted_confidence(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    given = F.create_map(F.lit("total_amount"), (50 + k % 50).cast("double"), F.lit("currency"), (k % 90).cast("double"), F.lit("other"), F.lit(80.0))
    return table(spark, folder, "orders").select("o_orderkey", quality.weighted_confidence(given).alias("confidence"))


def rule_labels(spark: SparkSession, folder: str) -> DataFrame:
    lines = render.documents(spark, folder).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.select(F.explode(labels.rule_labels(F.col("line"))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("lines"))


def table_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as tables with a header and a sum row."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("part"), F.format_string("%.0f", "l_quantity").alias("q"), F.format_string("%.2f", "l_extendedprice").alias("t"), "l_suppkey"
    )
    numbered = items.withColumn("row", F.expr("row_number() over (partition by doc_id order by n, part, t, l_suppkey)"))
    body = F.struct("row", F.array(F.concat(F.lit("part "), "part"), "q", F.concat(F.lit("$"), "t")).alias("v"))
    made = lambda row, *v: F.struct(F.lit(row).alias("row"), F.array(*map(F.lit, v)).alias("v"))
    # header and sum go with the first line, so that the lines are read and dealt once
    ends = F.when(F.col("row") == 1, F.array(made(0, "Item", "Qty", "Total"), made(999, "Subtotal", "1", "2.00"), body)).otherwise(F.array(body))
    cells = numbered.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.row", F.posexplode("e.v").alias("col", "value"))
    return labels.table_items(cells).select("doc_id", "row", "description", "quantity", "total")


def corrected_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as documents, with the newest corrections of the events of their number."""
    docs = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.create_map(F.lit("click"), F.lit("old"), F.lit("name"), F.col("c_name")).alias("extracted_data"), F.lit("EXTRACTED").alias("status")
    )
    fixes = render.corrections(spark, folder).withColumnRenamed("vendor_id", "doc_id")
    out = serve.corrected(docs, fixes)
    return out.select("doc_id", "status", F.size("extracted_data").alias("fields"), F.col("extracted_data")["click"].alias("click"), F.col("extracted_data")["name"].alias("name"))


def recent_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Every vendor's newest corrections; ten are the feature here."""
    newest = Window.partitionBy("vendor_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    rows = render.corrections(spark, folder).withColumn("place", F.row_number().over(newest)).where("place <= 10")
    return rows.select("vendor_id", "place", "id", "field_name", "corrected_value")


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = [table(spark, folder, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("orders", "supplier", "events")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


QUERIES = {
    f.__name__: f
    for f in (image_quality, page_geometry, weighted_confidence, rule_labels, table_items, corrected_documents, recent_corrections, table_counts)
}

ORACLES = {
    "image_quality": """WITH c AS (SELECT concat_ws(',', CASE WHEN 500 + k % 700 < 800 OR 400 + k % 900 < 600 THEN 'small' END, CASE WHEN 100 + k % 200 < 150 THEN 'low_dpi' END,
        CASE WHEN 50 + k % 150 < 100 THEN 'blurred' END, CASE WHEN 10 + k % 60 < 30 THEN 'low_contrast' END, CASE WHEN k % 256 < 50 THEN 'dark' WHEN k % 256 > 230 THEN 'bright' END) AS codes
      FROM (SELECT p_partkey AS k FROM part)) SELECT codes, count(*) AS images FROM c GROUP BY codes""",
    "page_geometry": """WITH s AS (SELECT p_partkey, p_partkey AS k, greatest(1000 + p_partkey % 1500, 1400 + p_partkey % 2100) :: DOUBLE AS l, least(1000 + p_partkey % 1500, 1400 + p_partkey % 2100) :: DOUBLE AS s FROM part),
      p AS (SELECT *, abs(l / s - 11.0 :: DOUBLE / 8.5 :: DOUBLE) <= abs(l / s - 11.69 :: DOUBLE / 8.27 :: DOUBLE) AS letter FROM s),
      d AS (SELECT *, CASE WHEN k % 4 = 0 THEN 200.0 :: DOUBLE WHEN letter THEN least(l / 11.0 :: DOUBLE, s / 8.5 :: DOUBLE) ELSE least(l / 11.69 :: DOUBLE, s / 8.27 :: DOUBLE) END AS dpi FROM p),
      r AS (SELECT *, greatest(CASE WHEN k % 3 = 0 THEN 350 ELSE 300 END / dpi, 1.0 :: DOUBLE) AS raw FROM d)
      SELECT p_partkey, CASE WHEN letter THEN 'letter' ELSE 'a4' END AS paper, round(dpi, 2) AS dpi, round(CASE WHEN raw - 1 < 0.05 THEN 1.0 :: DOUBLE ELSE raw END, 4) AS scale FROM r""",
    "weighted_confidence": "SELECT o_orderkey, round((2.0 :: DOUBLE * (50 + o_orderkey % 50) + 0.5 :: DOUBLE * (o_orderkey % 90) + 80) / 3.5 :: DOUBLE, 2) AS confidence FROM orders",
    "rule_labels": f"""WITH {DOCUMENTS} SELECT field, count(*) AS lines FROM docs, (VALUES ('invoice_number'), ('invoice_date'), ('total_amount')) f(field) GROUP BY field""",
    "table_items": """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey :: VARCHAR, printf('%.2f', l_extendedprice), l_suppkey) AS row,
        'part ' || l_partkey AS description, printf('%.0f', l_quantity) :: DOUBLE AS quantity, printf('%.2f', l_extendedprice) :: DOUBLE AS total FROM lineitem""",
    "corrected_documents": f"""WITH {CORRECTIONS}, l AS (SELECT vendor_id, field_name, arg_max(corrected_value, (created_at, id)) AS v FROM corrections GROUP BY ALL),
      g AS (SELECT vendor_id, count(*) FILTER (WHERE field_name <> 'click') :: INT AS n, max(v) FILTER (WHERE field_name = 'click') AS click FROM l GROUP BY vendor_id)
      SELECT c_custkey AS doc_id, CASE WHEN g.vendor_id IS NULL THEN 'EXTRACTED' ELSE 'CORRECTED' END AS status, (2 + coalesce(n, 0)) :: INT AS fields, coalesce(click, 'old') AS click, c_name AS name
      FROM customer LEFT JOIN g ON vendor_id = c_custkey""",
    "recent_corrections": f"""WITH {CORRECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY created_at DESC, id DESC) :: INT AS place FROM corrections)
      SELECT vendor_id, place, id, field_name, corrected_value FROM n WHERE place <= 10""",
    "table_counts": "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events",
}
