"""Queries of the anchored fields, the merge with its cleaning, and template learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import anchors, consensus, layout, templates
from fieldloom.plans import render
from fieldloom.plans.reading import item_tokens
from fieldloom.plans.sql import DOCUMENTS, TALLY, VOTES
from fieldloom.session import table


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").withColumn("doc_id", F.col("o_orderkey"))


def labelled_text_fields(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.labelled_text(render.documents(spark, folder)).select("doc_id", "field", "value", "score")


def label_dates_text(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' dates beside their label, some lines below it, or beside a printing date."""
    k, digits, named = F.col("doc_id"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format("o_orderdate", "MMMM d, yyyy")
    body = (
        F.when(k % 3 == 0, F.concat(F.lit("Invoice\n\nDate: "), named))
        .when(k % 3 == 1, F.concat(F.lit("Invoice Date\nRef 7\n"), digits))
        .otherwise(F.concat(F.lit("Date printed: 01/01/2001\nDue Date: "), digits))
    )
    return anchors.dates_in_text(_orders(spark, folder).select("doc_id", body.alias("text"))).select("doc_id", "field", "value", "score", "ord")


def label_dates_reach(spark: SparkSession, folder: str) -> DataFrame:
    lines = anchors.lines_with_tokens(layout.grouped_lines(render.tokens(spark, folder)))
    return anchors.dates_by_reach(lines).select("doc_id", "field", "value")


def due_line_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as three lines: a date, printed or not, a line of what is due, and a greeting."""
    k, padded = F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 8, "0")
    first = F.concat(F.when(k % 4 == 0, "Printed ").otherwise("Net "), F.date_format("o_orderdate", "MM/dd/yyyy"))
    second = F.when(k % 3 == 0, F.concat(F.lit("D U E "), padded)).otherwise(F.concat(F.lit("PQR-77 DUE | A"), padded))
    lines = _orders(spark, folder).select("doc_id", F.posexplode(F.array(first, second, F.lit("Thank you"))).alias("line_no", "text"))
    made = lines.withColumns({"page": F.lit(1), "source": F.lit("paddle_v1"), "conf": F.lit(0.8), "weight": F.lit(1.0)})
    return anchors.due_lines(made).select("doc_id", "field", "value", "score")


def totals_in_region(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pages: a decoy in the middle, a total line with or without its amount, a smaller sum below it."""
    k = F.col("doc_id")
    word = lambda line, text, x, y, height=12: F.struct(F.lit(line).alias("line_no"), text.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 80).alias("x1"), F.lit(y + height).alias("y1"))
    shown = F.format_string("%.2f", F.round("o_totalprice", 2))
    words = F.array_compact(
        F.array(
            word(0, F.lit("Page"), 920, 10), word(1, F.lit("9999.99"), 800, 300), word(2, F.lit("Total"), 100, 700), F.when(k % 2 == 0, word(2, shown, 800, 700)),
            word(3, F.lit("Sum"), 100, 800), word(3, F.lit("5.00"), 800, 800), word(4, F.lit("Thanks"), 100, 960, 40),
        )
    )
    tokens = _orders(spark, folder).select("doc_id", F.posexplode(words).alias("tok_no", "w")).select("doc_id", "tok_no", "w.*")
    lined = tokens.withColumns({"page": F.lit(1), "source": F.lit("tesseract_v3"), "conf": F.lit(0.9)})
    return anchors.totals_by_region(anchors.lines_with_tokens(lined)).select("doc_id", "value", "score", "ord")


def token_source(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two engines a document, of which the preferred one stays."""
    base = render.tokens(spark, folder)
    k = F.col("doc_id")
    both = base.withColumn("source", F.explode(F.array(F.when(k % 2 == 0, "tesseract_v3").otherwise(F.lit("trocr")), F.when(k % 3 == 0, "paddle_v2").otherwise(F.lit("paddle_v1")))))
    return anchors.chosen_source(both).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("tokens"))


def headerless_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as pages without a header: the columns are found from their numbers."""
    return layout.line_items(layout.grouped_lines(item_tokens(spark, folder).where("y0 > 0"))).select("doc_id", "item_no", "description", "quantity", "amount")


def _forced(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    made = lambda field, value: F.struct(F.lit(field).alias("field"), F.lit(value).alias("value"))
    rows = F.array_compact(F.array(F.when(k % 10 == 0, made("currency", "CHF")), F.when(k % 15 == 0, made("po_number", "PO-1")), F.when(k % 4 == 0, made("vendor_name", ""))))
    return _orders(spark, folder).select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*", F.lit(85.0).alias("confidence"))


def n_way_merge(spark: SparkSession, folder: str) -> DataFrame:
    fused = _orders(spark, folder).where("doc_id % 6 = 0").select("doc_id", F.lit("total_amount").alias("field"), F.format_string("%.2f", F.round("o_totalprice", 2)).alias("value"))
    merged = consensus.n_way(render.votes(spark, folder), _forced(spark, folder), fused)
    return merged.select("doc_id", "field", "value", "confidence", "agreement", F.array_join("selected_from", ",").alias("selected_from"))


def field_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = {
        "total_amount": F.concat(F.lit("$"), F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit(" ")),
        "invoice_date": render.date_text(F.col("o_orderdate"), k),
        "invoice_number": F.concat(F.lit(" --INV   "), k.cast("string")),
        "currency": F.when(k % 3 == 0, "usd").when(k % 3 == 1, "in chf").otherwise("12"),
        "vendor_name": F.concat(F.lit("  Supplier "), F.col("o_custkey").cast("string")),
        "_raw": F.lit("internal"),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in raw.items()])
    return consensus.field_cleaned(table(spark, folder, "orders").select(k.alias("doc_id"), F.explode(rows).alias("f")).select("doc_id", "f.*"))


def _of(spark: SparkSession, folder: str, voter: str) -> DataFrame:
    return render.votes(spark, folder).where(F.col("voter") == voter).select("doc_id", "field", "value")


def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two voters' readings as the runs before and after."""
    changes = consensus.compared(_of(spark, folder, "docling"), _of(spark, folder, "impira"))
    return changes.groupBy("field", "change").agg(F.count(F.lit(1)).alias("fields"))


def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.scored(_of(spark, folder, "impira"), _of(spark, folder, "docling"))


def triple_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    merged = consensus.field_vote(render.votes(spark, folder)).where("field <> 'invoice_number' or doc_id % 2 = 0").select("doc_id", "field", "value", "confidence")
    return consensus.fanned_out(merged)


def failure_records(spark: SparkSession, folder: str) -> DataFrame:
    records = consensus.merged(consensus.field_vote(render.votes(spark, folder).where("doc_id % 9 <> 0")))
    out = consensus.with_failures(_orders(spark, folder), records)
    return out.select("doc_id", F.size("fields").alias("fields"), "status", "error")


def template_learning(spark: SparkSession, folder: str) -> DataFrame:
    """Customers' templates, half of them new, after all orders' fields."""
    old = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("vendor_id"), F.lit("total_amount").alias("field"), F.array(F.lit("seed"), F.lit("3")).alias("examples"), F.lit(75.0).alias("confidence"), F.lit(2).cast("long").alias("occurrences")
    )
    new = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("vendor_id"), F.lit("total_amount").alias("field"), (F.col("o_orderkey") % 7).cast("string").alias("value"),
        (60 + F.col("o_orderkey") % 40).cast("double").alias("confidence"), F.col("o_orderdate").alias("seen"),
    )
    return templates.learned(old, new).withColumn("examples", F.array_join("examples", ","))


def correction_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as documents whose total was corrected, or confirmed, and a new field was given."""
    k = F.col("doc_id")
    total = F.format_string("%.2f", F.round("o_totalprice", 2))
    docs = _orders(spark, folder).select(
        "doc_id",
        F.col("o_custkey").alias("vendor_id"),
        F.create_map(F.lit("total_amount"), total).alias("extracted_data"),
        F.create_map(F.lit("total_amount"), F.when(k % 2 == 0, total).otherwise(F.lit("1.00")), F.lit("po_number"), F.lit("PO-1")).alias("corrected"),
    )
    rows = templates.recorded(docs, F.lit("2024-01-01").cast("timestamp"))
    return rows.select("doc_id", "vendor_id", "field_name", "original_value", "corrected_value")


def crop_values(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of orders' anchored regions as values of their fields, as of 1997."""
    k = F.col("o_orderkey")
    crops = {
        "invoice_date": F.concat(F.lit("x 12 "), F.when(k % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")), F.lit(" 7")),
        "total_amount": F.concat(F.lit("10 USD "), F.when(k % 2 == 0, F.format_string("%.2f", F.round("o_totalprice", 2) % 1000)).otherwise(F.lit("1.234,50"))),
        "invoice_number": F.when(k % 2 == 0, F.concat(F.lit(" INV "), k.cast("string"))).otherwise(F.lit("none")),
        "vendor_note": F.lit("  as is "),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("crop")) for f, c in crops.items()])
    out = table(spark, folder, "orders").select(k.alias("doc_id"), F.explode(rows).alias("c")).select("doc_id", "c.*")
    return out.select("doc_id", "field", templates.crop_value(F.col("field"), F.col("crop"), F.lit("1997-06-01").cast("timestamp")).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        labelled_text_fields, label_dates_text, label_dates_reach, due_line_fields, totals_in_region, token_source, headerless_items, n_way_merge, field_cleaning, run_comparison,
        field_accuracy, triple_fan_out, failure_records, template_learning, correction_records, crop_values,
    )
}

_TWO_RUNS = f"""{VOTES}, a AS (SELECT doc_id, field, value FROM votes WHERE voter = 'docling'), b AS (SELECT doc_id, field, value FROM votes WHERE voter = 'impira')"""
ORACLES = {
    "labelled_text_fields": f"""WITH {DOCUMENTS} SELECT doc_id, field, CASE field WHEN 'invoice_number' THEN 'INV-' || strftime(o_orderdate, '%Y') || '-' || doc_id WHEN 'invoice_date' THEN date_text ELSE amount_text END AS value,
        0.4 :: DOUBLE AS score FROM docs JOIN orders ON doc_id = o_orderkey, (VALUES ('invoice_number'), ('invoice_date'), ('total_amount')) f(field)""",
    "label_dates_text": """SELECT o_orderkey AS doc_id, field, strftime(o_orderdate, '%m/%d/%Y') AS value, CASE WHEN o_orderkey % 3 = 1 THEN 0.45 ELSE 0.55 END :: DOUBLE AS score,
        CASE WHEN o_orderkey % 3 = 1 THEN 0 ELSE 1 END :: INT AS ord FROM orders, (VALUES ('invoice_date'), ('due_date')) f(field) WHERE field = 'invoice_date' OR o_orderkey % 3 = 2""",
    "label_dates_reach": f"""WITH {DOCUMENTS} SELECT doc_id, 'invoice_date' AS field, CASE WHEN doc_id % 5 = 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN doc_id % 5 = 0 AND year(o_orderdate) % 100 BETWEEN 1 AND 12 THEN strftime(o_orderdate, '%y/%m/%d') ELSE strftime(o_orderdate, '%m/%d/%Y') END AS value
      FROM docs JOIN orders ON doc_id = o_orderkey WHERE doc_id % 5 <> 2 OR day(o_orderdate) <= 12""",
    "due_line_fields": """WITH f AS (SELECT o_orderkey AS doc_id, field, CASE field WHEN 'invoice_date' THEN CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%m/%d/%Y') END
          WHEN 'invoice_number' THEN CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'A' END || lpad(o_orderkey :: VARCHAR, 8, '0')
          ELSE CASE WHEN o_orderkey % 3 = 0 THEN lpad(o_orderkey :: VARCHAR, 8, '0') ELSE 'PQR-77' END END AS value, 0.8 :: DOUBLE AS score
        FROM orders, (VALUES ('invoice_date'), ('invoice_number'), ('po_number')) f(field)) SELECT * FROM f WHERE value IS NOT NULL""",
    "totals_in_region": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN printf('%.2f', round(o_totalprice, 2)) ELSE '5.00' END AS value,
        CASE WHEN o_orderkey % 2 = 0 THEN 1.71 ELSE 1.51 END :: DOUBLE AS score, 2 :: INT AS ord FROM orders""",
    "token_source": f"""WITH {DOCUMENTS}, t AS (SELECT doc_id, len(string_split(replace(text, chr(10), ' '), ' ')) AS tokens FROM docs)
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tesseract_v3' WHEN doc_id % 3 = 0 THEN 'paddle_v2' ELSE 'paddle_v1' END AS source, tokens FROM t""",
    "headerless_items": """WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS lines, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS item_no FROM lineitem)
      SELECT l_orderkey AS doc_id, item_no :: INT AS item_no, 'part' || l_partkey AS description, printf('%.0f', l_quantity) :: DOUBLE AS quantity, printf('%.2f', l_extendedprice) :: DOUBLE AS amount FROM n WHERE lines >= 2""",
    "n_way_merge": f"""WITH {TALLY}, v AS (SELECT doc_id, field, value, confidence, agreement, array_to_string(voters, ',') AS selected_from FROM resolved)
      SELECT doc_id, field, 'CHF' AS value, 85.0 :: DOUBLE AS confidence, 'forced_template' AS agreement, 'ocr_template' AS selected_from FROM v WHERE field = 'currency' AND doc_id % 10 = 0
      UNION ALL SELECT o_orderkey, 'po_number', 'PO-1', 85.0, 'forced_template', 'ocr_template' FROM orders WHERE o_orderkey % 15 = 0
      UNION ALL SELECT doc_id, field, printf('%.2f', round(o_totalprice, 2)), 82.0, 'fused_override', 'ocr_fused' FROM v JOIN orders ON doc_id = o_orderkey WHERE field = 'total_amount' AND doc_id % 6 = 0
      UNION ALL SELECT * FROM v WHERE NOT (field = 'currency' AND doc_id % 10 = 0) AND NOT (field = 'total_amount' AND doc_id % 6 = 0)""",
    "field_cleaning": """SELECT o_orderkey AS doc_id, field, CASE field WHEN 'total_amount' THEN printf('%.2f', round(o_totalprice, 2)) WHEN 'invoice_number' THEN 'INV ' || o_orderkey WHEN 'vendor_name' THEN 'Supplier ' || o_custkey
        WHEN 'currency' THEN CASE o_orderkey % 3 WHEN 1 THEN 'CHF' ELSE 'USD' END
        ELSE CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE strftime(o_orderdate, '%-d %b %Y') END END AS value
      FROM orders, (VALUES ('total_amount'), ('invoice_date'), ('invoice_number'), ('currency'), ('vendor_name')) f(field)""",
    "run_comparison": f"""WITH {_TWO_RUNS} SELECT field, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'same' WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'lost' WHEN a.value = b.value THEN 'same' ELSE 'changed' END AS change,
        count(*) AS fields FROM a FULL JOIN b USING (doc_id, field) GROUP BY ALL""",
    "field_accuracy": f"""WITH {_TWO_RUNS}, k AS (SELECT field, replace(lower(trim(b.value)), ' ', '') AS x, replace(lower(trim(a.value)), ' ', '') AS y FROM a LEFT JOIN b USING (doc_id, field)),
      r AS (SELECT field, count(*) AS expected, sum(coalesce(x = y OR (len(x) > 5 AND len(y) > 5 AND (contains(x, y) OR contains(y, x))), false) :: INT) :: BIGINT AS "right" FROM k GROUP BY field)
      SELECT *, round("right" * 100 / expected, 2) AS accuracy FROM r""",
    "triple_fan_out": f"""WITH {TALLY}, m AS (SELECT doc_id, field, value, confidence FROM resolved WHERE field <> 'invoice_number' OR doc_id % 2 = 0)
      SELECT doc_id, voter, ord :: INT AS voter_ord, field, value, coalesce(max(confidence) FILTER (WHERE field = source) OVER (PARTITION BY doc_id, voter), 85.0 :: DOUBLE) AS confidence
      FROM m, (VALUES ('impira', 1, 'invoice_number'), ('layoutlm', 2, 'total_amount'), ('donut', 3, 'vendor_name')) f(voter, ord, source)""",
    "failure_records": """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 9 <> 0 THEN 4 ELSE 0 END :: INT AS fields, CASE WHEN o_orderkey % 9 <> 0 THEN 'EXTRACTED' ELSE 'FAILED' END AS status,
        CASE WHEN o_orderkey % 9 = 0 THEN 'no voter ran' END AS error FROM orders""",
    "template_learning": """WITH v AS (SELECT o_custkey AS vendor_id, (o_orderkey % 7) :: VARCHAR AS value, min(o_orderdate) AS seen, max(60 + o_orderkey % 40) AS confidence, count(*) AS n FROM orders GROUP BY ALL),
      g AS (SELECT vendor_id, max(confidence) AS confidence, sum(n) AS n, list(value ORDER BY seen, value) FILTER (WHERE vendor_id % 2 <> 0 OR value <> '3') AS fresh FROM v GROUP BY vendor_id),
      c AS (SELECT c_custkey AS vendor_id FROM customer WHERE c_custkey % 2 = 0),
      j AS (SELECT coalesce(c.vendor_id, g.vendor_id) AS vendor_id, greatest(CASE WHEN c.vendor_id IS NOT NULL THEN 75 END, g.confidence) :: DOUBLE AS confidence,
        (coalesce(n, 0) + CASE WHEN c.vendor_id IS NULL THEN 0 ELSE 2 END) :: BIGINT AS occurrences,
        list_concat(CASE WHEN c.vendor_id IS NULL THEN [] ELSE ['seed', '3'] END, coalesce(fresh, [])) AS every FROM c FULL JOIN g ON c.vendor_id = g.vendor_id)
      SELECT vendor_id, 'total_amount' AS field, array_to_string(every[greatest(len(every) - 4, 1) :], ',') AS examples, confidence, occurrences FROM j""",
    "correction_records": """SELECT o_orderkey AS doc_id, o_custkey AS vendor_id, 'po_number' AS field_name, NULL :: VARCHAR AS original_value, 'PO-1' AS corrected_value FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, 'total_amount', printf('%.2f', round(o_totalprice, 2)), '1.00' FROM orders WHERE o_orderkey % 2 <> 0""",
    "crop_values": """SELECT o_orderkey AS doc_id, field, CASE field WHEN 'invoice_date' THEN CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1999 THEN strftime(o_orderdate, '%Y-%m-%d') END
        WHEN 'total_amount' THEN CASE WHEN o_orderkey % 2 = 0 THEN printf('%.2f', round(o_totalprice, 2) % 1000) ELSE '1234.50' END
        WHEN 'invoice_number' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'INV ' || o_orderkey END ELSE 'as is' END AS value
      FROM orders, (VALUES ('invoice_date'), ('total_amount'), ('invoice_number'), ('vendor_note')) f(field)""",
}
