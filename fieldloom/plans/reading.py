"""Queries of extraction, layout, fusion and page operators over rendered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import extract, fusion, layout
from fieldloom.plans import render
from fieldloom.plans.sql import DOCUMENTS
from fieldloom.sources import files
from fieldloom.session import table

#: About how many documents a task turns into words where these are sorted.
DOCUMENTS_OF_TASK = 50_000


def text_voter_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.text_voter(F.replace("text", F.lit("Invoice No: "), F.lit("No. ")))
    return render.documents(spark, folder).select("doc_id", found.alias("f")).select(
        "doc_id", "f.currency", F.round("f.total_amount", 2).alias("total_amount"), "f.invoice_date", "f.invoice_number"
    )


def document_parser_extract(spark: SparkSession, folder: str) -> DataFrame:
    votes = extract.voted(render.documents(spark, folder), extract.DOCUMENT_PARSER, "docling", 0)
    return votes.select("doc_id", "voter", "field", "value")


def layout_text_extract(spark: SparkSession, folder: str) -> DataFrame:
    votes = extract.voted(render.documents(spark, folder), extract.LAYOUT_TEXT, "layoutlm", 2)
    return votes.select("doc_id", "field", "value", "confidence")


def tagged_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Tagged sequences made of orders; the last price is the total."""
    sequence = F.concat(
        F.lit("<s_nm> NORTHERN & CO INC</s_nm> Order # "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(" "), F.date_format("o_orderdate", "dd-MM-yyyy"),
        F.lit(" <s_price> 1.00</s_price> <s_price> "), F.format_string("%.2f", F.round("o_totalprice", 2)), F.lit("</s_price>"),
    )
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), sequence.alias("text"))
    return extract.voted(docs, extract.TAGGED, "donut", 3).select("doc_id", "field", "value")


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered documents as a grid: a line to a row, a decoy in the second column."""
    lines = render.documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    both = lines.select("doc_id", "row", F.posexplode(F.array("line", F.concat(F.lit("Sample Vendor: Your Company "), F.col("row").cast("string")))).alias("col", "value"))
    return both


def cell_grid_extract(spark: SparkSession, folder: str) -> DataFrame:
    is_total = F.col("field") == "total_amount"
    return extract.from_cells(_cells(spark, folder)).select(
        "doc_id", "field", F.when(~is_total, F.col("value")).alias("value"), F.when(is_total, F.round(F.col("value").cast("double"), 2)).alias("amount"), "confidence"
    )


def payment_schedule_total(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as payment schedules, or with a labelled total, or bare."""
    k, total = F.col("o_orderkey"), F.round("o_totalprice", 2)
    shown = F.format_string("%.2f", total)
    body = (
        F.when(k % 3 == 0, F.concat(F.lit("Payment schedule: $10.00 then $20.00 then $"), shown))
        .when(k % 3 == 1, F.concat(F.lit("Paid 5.00. Invoice Total: $"), shown))
        .otherwise(F.lit("nothing written"))
    )
    return table(spark, folder, "orders").select("o_orderkey", F.round(extract.schedule_total(body, F.lit(7.5)), 2).alias("total"))


def labelled_total(spark: SparkSession, folder: str) -> DataFrame:
    """Three amounts of which one is named, or none and a subtotal is the largest."""
    k, total = F.col("o_orderkey"), F.round("o_totalprice", 2)
    shown = F.format_string("%.2f", total)
    body = F.when(k % 2 == 0, F.concat(F.lit("Grand Total: $"), shown)).otherwise(F.concat(F.lit("subtotal line "), F.format_string("%.2f", total * 2), F.lit(" " * 60), F.lit("sum "), shown))
    amounts = F.array(F.lit(3.0), total, F.when(k % 2 == 0, F.lit(4.0)).otherwise(total * 2))
    return table(spark, folder, "orders").select("o_orderkey", F.round(extract.chosen_total(body, amounts, F.lit(0.0)), 2).alias("total"))


def token_column_clusters(spark: SparkSession, folder: str) -> DataFrame:
    # the sort of a task holds the words of its documents, so these are bounded, whatever the size of the table
    return layout.numeric_columns(render.tokens(spark, folder, DOCUMENTS_OF_TASK)).select("doc_id", "cluster", "tokens", "centre")


def line_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found again from positions alone, against those rendered."""
    lines = layout.line_texts(layout.grouped_lines(render.tokens(spark, folder)))
    return lines.select("doc_id", "line_no", "text", F.round("conf", 4).alias("conf"))


def anchored_fields(spark: SparkSession, folder: str) -> DataFrame:
    lines = layout.line_texts(layout.grouped_lines(render.tokens(spark, folder)))
    return fusion.fused(layout.anchored(lines)).select("doc_id", "field", "value")


def footer_total_pick(spark: SparkSession, folder: str) -> DataFrame:
    return layout.footer_totals(render.tokens(spark, folder)).select("doc_id", "value")


def item_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a page: a header and a line to each item."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")).alias("line"),
        F.array(
            F.concat(F.lit("part"), F.col("l_partkey").cast("string")), F.format_string("%.0f", F.col("l_quantity")),
            F.format_string("%.2f", F.col("l_extendedprice") / F.col("l_quantity")), F.format_string("%.2f", F.col("l_extendedprice")),
        ).alias("words"),
    )
    # the header goes with the first line, so that pages need not be dealt again for it
    head = F.struct(F.lit(0).alias("line"), F.array(*map(F.lit, ("Description", "Qty", "Price", "Amount"))).alias("words"))
    lines = F.explode(F.array_compact(F.array(F.when(F.col("line") == 1, head), F.struct("line", "words"))))
    words = items.select("doc_id", lines.alias("l")).select("doc_id", "l.line", F.posexplode("l.words").alias("place", "text"))
    return words.select(
        "doc_id", F.lit(1).alias("page"), F.lit("tesseract_v3").alias("source"), (F.col("line") * 10 + F.col("place")).cast("int").alias("tok_no"), "text", F.lit(0.9).alias("conf"),
        (F.col("place") * 150).cast("int").alias("x0"), (F.col("line") * 40).cast("int").alias("y0"), (F.col("place") * 150 + 60).cast("int").alias("x1"), (F.col("line") * 40 + 12).cast("int").alias("y1"),
    )


def line_item_parse(spark: SparkSession, folder: str) -> DataFrame:
    return layout.line_items(layout.grouped_lines(item_tokens(spark, folder))).select("doc_id", "item_no", "description", "quantity", "amount")


def token_match(spark: SparkSession, folder: str) -> DataFrame:
    """The token of each rendered document's number."""
    docs = render.documents(spark, folder).repartition("doc_id")  # dealt as documents, not as tokens
    tokens = render.tokens_of(docs)
    values = docs.select("doc_id", F.lit("total_amount").alias("field"), F.col("amount_text").alias("value"))
    return layout.matching_tokens(values, tokens).select("doc_id", "token", F.col("box")[0].alias("x0"))


def fusion_override(spark: SparkSession, folder: str) -> DataFrame:
    """Fused dates and totals against an unreadable or undecimalled vote."""
    docs = render.documents(spark, folder)
    k = F.col("doc_id")
    vote = lambda voter, field, value, conf: F.struct(F.lit(voter).alias("voter"), F.lit(field).alias("field"), value.alias("value"), F.lit(conf).alias("confidence"))
    votes = docs.select(
        "doc_id",
        F.explode(
            F.array(
                vote("ocr_fused", "invoice_date", F.col("date_text"), 55.0),
                vote("donut", "invoice_date", F.when(k % 2 == 0, "unreadable").otherwise(F.lit("2020-01-01")), 80.0),
                vote("ocr_fused", "total_amount", F.col("amount_text"), 55.0),
                vote("donut", "total_amount", F.when(k % 3 == 0, "48226").otherwise(F.lit("12.50")), 80.0),
            )
        ).alias("v"),
    ).select("doc_id", "v.*")
    is_total = F.col("field") == "total_amount"
    return fusion.overrides(votes).select(
        "doc_id", "field", F.when(~is_total, F.col("value")).alias("value"), F.when(is_total, F.round(F.col("value").cast("double"), 2)).alias("amount")
    )


def multipage_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as pages of a document that all name one number, or two."""
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.round("l_extendedprice", 2).alias("total"))
    number = F.concat(F.lit("N-"), F.col("doc_id").cast("string"), F.when((F.col("doc_id") % 4 == 0) & (F.col("page") % 2 == 0), "b").otherwise(""))
    return fusion.merged_pages(rows.withColumn("invoice_number", number), rows.select("doc_id", "page"))


def upload_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Files of given names and sizes: pages' addresses as paths, the html's length as size."""
    ending = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".csv", ".exe", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, folder, "pages").select("page_id", F.concat(F.lit("uploads/p"), F.col("page_id").cast("string"), ending).alias("path"), F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.length("html") * 1000).alias("size"))
    return rows.select("page_id", files.kind(F.col("path")).alias("kind"), files.rejection(F.col("path"), F.col("size")).alias("rejected"))


QUERIES = {
    f.__name__: f
    for f in (
        text_voter_extract, document_parser_extract, layout_text_extract, tagged_extract, cell_grid_extract, payment_schedule_total, labelled_total,
        token_column_clusters, line_grouping, anchored_fields, footer_total_pick, line_item_parse, token_match, fusion_override, multipage_merge, upload_admission,
    )
}

_NUMBER = "'INV-' || strftime(o_orderdate, '%Y') || '-' || o_orderkey"
ORACLES = {
    "text_voter_extract": f"""WITH {DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'USD' END AS currency, round(cents / 100.0, 2) :: DOUBLE AS total_amount,
        CASE doc_id % 5 WHEN 2 THEN NULL WHEN 0 THEN CASE WHEN year(o_orderdate) % 100 BETWEEN 1 AND 12 AND day(o_orderdate) < 31 THEN strftime(o_orderdate, '20%d-%y-%m') END
          ELSE strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
        CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN NULL ELSE {_NUMBER} END AS invoice_number FROM docs JOIN orders ON doc_id = o_orderkey""",
    "cell_grid_extract": f"""WITH {DOCUMENTS}, c AS (
        SELECT o_orderkey AS doc_id, 'vendor_name' AS field, 'Northern Trading' AS value, NULL :: DOUBLE AS amount FROM orders
        UNION ALL SELECT o_orderkey, 'invoice_number', strftime(o_orderdate, '%Y') || '-' || o_orderkey, NULL FROM orders
        UNION ALL SELECT o_orderkey, 'invoice_date', CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN strftime(o_orderdate, '%Y-%m-%d') END, NULL FROM orders
        UNION ALL SELECT doc_id, 'total_amount', NULL, CASE WHEN doc_id % 4 IN (0, 2) THEN round(cents / 100.0, 2) WHEN doc_id % 4 = 1 AND high > 0 THEN (high || '.' || low[1:2]) :: DOUBLE ELSE cents END :: DOUBLE
          FROM docs JOIN parts USING (doc_id, cents))
      SELECT doc_id, field, value, amount, 95.0 :: DOUBLE AS confidence FROM c WHERE value IS NOT NULL OR amount IS NOT NULL""",
    "tagged_extract": """SELECT o_orderkey AS doc_id, field, CASE field WHEN 'vendor_name' THEN 'NORTHERN & CO INC' WHEN 'invoice_number' THEN lpad(o_orderkey :: VARCHAR, 8, '0')
        WHEN 'invoice_date' THEN strftime(o_orderdate, '%d-%m-%Y') ELSE printf('%.2f', round(o_totalprice, 2)) END AS value
      FROM orders, (VALUES ('vendor_name'), ('invoice_number'), ('invoice_date'), ('total_amount')) f(field)""",
    "payment_schedule_total": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 7.5 ELSE round(o_totalprice, 2) END :: DOUBLE AS total FROM orders",
    "labelled_total": "SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders",
    "token_column_clusters": f"""WITH {DOCUMENTS}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM docs),
      words AS (SELECT doc_id, y, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS p FROM lines),
      t AS (SELECT *, p * 90 + 20 AS x0, p * 90 + 20 + len(word) * 8 AS x1, max(p * 90 + 20 + len(word) * 8) OVER (PARTITION BY doc_id) AS width FROM words),
      n AS (SELECT *, (x0 + x1) / 2 AS c FROM t WHERE regexp_matches(word, '^[$€£]?-?[0-9][0-9.,]*$')),
      g AS (SELECT *, coalesce((c - lag(c) OVER w > greatest(24, width * 0.04)) :: INT, 0) AS new FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY c, y * 20 + p)),
      k AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY c, y * 20 + p)) :: INT AS cluster FROM g)
      SELECT doc_id, cluster, count(*) AS tokens, round(avg(c), 3) AS centre FROM k GROUP BY doc_id, cluster""",
    "line_grouping": f"""WITH {DOCUMENTS}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM docs)
      SELECT doc_id, y :: INT AS line_no, text, round(list_avg(list_transform(range(0, len(string_split(text, ' '))), lambda p: 0.6 + ((doc_id + p) % 4) / 10.0)), 4) :: DOUBLE AS conf FROM lines""",
    "anchored_fields": f"""WITH {DOCUMENTS} SELECT doc_id, field, CASE field WHEN 'invoice_number' THEN {_NUMBER} WHEN 'invoice_date' THEN date_text ELSE amount_text END AS value
      FROM docs JOIN orders ON doc_id = o_orderkey, (VALUES ('invoice_number'), ('invoice_date'), ('total_amount')) f(field)""",
    "document_parser_extract": f"""WITH {DOCUMENTS} SELECT doc_id, 'docling' AS voter, field, value FROM (
        SELECT doc_id, 'invoice_date' AS field, CASE WHEN doc_id % 5 = 1 OR (doc_id % 5 = 4 AND month(o_orderdate) = 5) THEN date_text END AS value FROM docs JOIN orders ON doc_id = o_orderkey
        UNION ALL SELECT doc_id, 'total_amount', CASE WHEN doc_id % 4 = 1 AND high > 0 THEN high || '.' || low ELSE replace(amount_text, '$', '') END FROM docs JOIN parts USING (doc_id)) WHERE value IS NOT NULL""",
    "layout_text_extract": f"""WITH {DOCUMENTS} SELECT doc_id, field, value, confidence FROM (
        SELECT doc_id, 'invoice_number' AS field, substr({_NUMBER}, 4) AS value, 90.0 :: DOUBLE AS confidence FROM docs JOIN orders ON doc_id = o_orderkey
        UNION ALL SELECT doc_id, 'invoice_date', CASE WHEN doc_id % 5 = 1 THEN date_text END, 90.0 FROM docs
        UNION ALL SELECT doc_id, 'total_amount', CASE WHEN doc_id % 4 IN (0, 2) THEN replace(amount_text, '$', '') WHEN doc_id % 4 = 1 AND high > 0 THEN high || '.' || low[1:2] END, 85.0
          FROM docs JOIN parts USING (doc_id)) WHERE value IS NOT NULL""",
    "token_match": f"WITH {DOCUMENTS} SELECT doc_id, amount_text AS token, 110 :: INT AS x0 FROM docs",
    "fusion_override": f"""WITH {DOCUMENTS} SELECT doc_id, 'invoice_date' AS field, CASE WHEN doc_id % 5 = 2 AND day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
        NULL :: DOUBLE AS amount FROM docs JOIN orders ON doc_id = o_orderkey WHERE doc_id % 2 = 0
      UNION ALL SELECT doc_id, 'total_amount', NULL, round(cents / 100.0, 2) :: DOUBLE FROM docs WHERE doc_id % 3 = 0""",
    "footer_total_pick": f"WITH {DOCUMENTS} SELECT doc_id, replace(amount_text, '$', '') AS value FROM docs",
    "line_item_parse": """WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS lines, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS item_no FROM lineitem)
      SELECT l_orderkey AS doc_id, item_no :: INT AS item_no, 'part' || l_partkey AS description, printf('%.0f', l_quantity) :: DOUBLE AS quantity, printf('%.2f', l_extendedprice) :: DOUBLE AS amount FROM n WHERE lines >= 2""",
    "multipage_merge": """WITH p AS (SELECT l_orderkey AS doc_id, count(*) AS pages, count(DISTINCT CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber % 2 ELSE 0 END) AS numbers, min(l_linenumber) AS first,
        arg_min(round(l_extendedprice, 2), (l_linenumber, round(l_extendedprice, 2))) AS total, count(*) FILTER (WHERE l_linenumber = 1) AS ones FROM lineitem GROUP BY l_orderkey)
      SELECT doc_id, pages, numbers > 1 AS multiple_invoices, 'N-' || doc_id || CASE WHEN doc_id % 4 = 0 AND first % 2 = 0 THEN 'b' ELSE '' END AS invoice_number, total,
        CASE WHEN numbers <= 1 THEN pages ELSE ones END AS line_items FROM p""",
    "upload_admission": """SELECT page_id, ['pdf', 'image', 'csv', 'unknown', 'unknown'][page_id % 5 + 1] AS kind,
        CASE WHEN page_id % 7 <> 0 AND len(html) * 1000 > 10485760 THEN 'too_large' WHEN page_id % 7 = 0 OR len(html) = 0 THEN 'empty' WHEN page_id % 5 >= 3 THEN 'unknown_kind' END AS rejected FROM pages""",
}
