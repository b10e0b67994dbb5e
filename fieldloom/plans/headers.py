"""Recognised text with header lines and several totals, and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.text import CURRENCY_CODES
from fieldloom.operators import header
from fieldloom.session import table

# What a line of the text is, by the order's number modulo the length of its row; {} stands for a value.
_LINES = (
    ("ACME TOOLS & CO", "Invoice", "  northern trading", "CUSTOMER", "", "Receipt 12"),
    ("BILL TO", "Blue Harbor Works", "", "BRIGHT LAMPS, LLC", "HARBOR 99 WORKS"),
    ("GRAND HOTEL S", "Order # {key}", "invoice no: A-{key}", "#{key}Z", "invoice # 01/02/2003"),
    ("Date: {us}", "dated {dm}", "seen {iso} or {us}", "on 99/99/2001", ""),
    ("Labor Total: $12.50", "Parts total 99.10", "subtotal 1.00", ""),
    ("Tax total: 3.00", "Total: ${amount}", "", "TOTAL {amount}"),
    ("Total: $7.00", "Amount due: {amount}", "balance due: ,", "", "Total (USD): {amount}"),
    ("PO # P-{key}77", "paid in EUR", "p.o. 12", "£ only", "GBP USDX", "€"),
)
TEXTS_OF_TASK = 250_000


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text, confidence): eight lines of every order, each of several kinds."""
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    values = {"{key}": k.cast("string"), "{us}": F.date_format(date, "MM/dd/yyyy"), "{dm}": F.date_format(date, "dd-MM-yyyy"), "{iso}": F.date_format(date, "yyyy-MM-dd"),
              "{amount}": F.format_number(F.round("o_totalprice", 2), 2)}
    lines = []
    for n, row in enumerate(_LINES):
        lines.append(F.element_at(F.array(*map(F.lit, row)), ((k + n) % len(row) + 1).cast("int")))
    text = F.array_join(F.array(*lines), "\n")
    for mark, value in values.items():  # once a text, not once a line
        text = F.replace(text, F.lit(mark), value)
    # dealt while rows are narrow: a file of few splits would leave the texts, which are the work, to few tasks, and so would tasks joined by their few bytes
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    orders = orders.repartition(max(spark.sparkContext.defaultParallelism, -(-orders.count() // TEXTS_OF_TASK)), "o_orderkey")
    return orders.select(k.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), (F.lit(60.0) + k % 40).alias("confidence"))


def header_lines(spark: SparkSession, folder: str) -> DataFrame:
    return header.header_fields(texts(spark, folder))


def scored_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return header.scored_fields(texts(spark, folder))


QUERIES = {f.__name__: f for f in (header_lines, scored_candidates)}


def _line(n: int, row: tuple[str, ...]) -> str:
    out = f"[{', '.join(repr(x) for x in row)}][(o_orderkey + {n}) % {len(row)} + 1]"
    for mark, value in (("{key}", "o_orderkey :: VARCHAR"), ("{us}", "strftime(o_orderdate, '%m/%d/%Y')"), ("{dm}", "strftime(o_orderdate, '%d-%m-%Y')"), ("{iso}", "strftime(o_orderdate, '%Y-%m-%d')"), ("{amount}", "format('{:,.2f}', round(o_totalprice, 2))")):
        out = f"replace({out}, '{mark}', {value})"
    return out


_TEXTS = f"""t AS (SELECT o_orderkey AS doc_id, concat_ws(chr(10), {', '.join(_line(n, r) for n, r in enumerate(_LINES))}) AS text, 60.0 :: DOUBLE + o_orderkey % 40 AS base FROM orders
), l AS (
  SELECT doc_id, base, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t
), c AS (
  SELECT *, len(regexp_replace(line, '[^A-Z]', '', 'g')) / nullif(len(line), 0) :: DOUBLE AS capitals, row_number() OVER (PARTITION BY doc_id, line <> '' ORDER BY n) AS place FROM l
)"""
_LADDER = "CASE WHEN contains(text, '$') OR regexp_matches(text, '(?i)\\bUSD\\b') THEN 'USD' WHEN contains(text, '€') OR regexp_matches(text, '(?i)\\bEUR\\b') THEN 'EUR' WHEN contains(text, '£') OR regexp_matches(text, '(?i)\\bGBP\\b') THEN 'GBP' ELSE 'USD' END"
_FORMATS = ", ".join(f"try_strptime(v, '{f}')" for f in ("%m-%d-%Y", "%m/%d/%Y", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m-%d", "%Y/%m/%d"))

ORACLES = {
    "header_lines": f"""WITH {_TEXTS} SELECT doc_id, voter, field, value, confidence :: DOUBLE AS confidence FROM (
        SELECT doc_id, 'docling' AS voter, 'vendor_name' AS field, line AS value, 75 AS confidence FROM c
          WHERE n <= 10 AND len(line) > 3 AND regexp_matches(line, '^[A-Z]') AND NOT regexp_matches(line, '(?i)invoice|receipt') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1
        UNION ALL SELECT doc_id, 'layoutlm', 'vendor_name', line, 90 FROM c WHERE n <= 5 AND len(line) > 5 AND capitals > 0.5 AND NOT regexp_matches(line, '[0-9]{{3,}}')
          AND NOT regexp_matches(line, '(?i)customer|bill to|ship to|date') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1
        UNION ALL SELECT doc_id, 'docling', 'currency', coalesce(nullif(regexp_extract(text, '\\b({'|'.join(CURRENCY_CODES)})\\b'), ''),
          CASE WHEN contains(text, '$') THEN 'USD' WHEN contains(text, '€') THEN 'EUR' WHEN contains(text, '£') THEN 'GBP' END), 75 FROM t
        UNION ALL SELECT doc_id, 'layoutlm', 'currency', {_LADDER}, 95 FROM t
        UNION ALL SELECT doc_id, 'layoutlm', 'po_number', nullif(regexp_extract(text, '(?i)(?:po|p\\.o\\.|purchase order)\\s*#?[:\\s]*([A-Z0-9-]{{4,}})', 1), ''), 85 FROM t) WHERE value IS NOT NULL""",
    "scored_candidates": f"""WITH {_TEXTS}, vendor AS (
        SELECT doc_id, base, 10 AS bonus, place, trim(regexp_extract(line, '^([A-Z][A-Z\\s&\\.,]+(?:RECEIPT|INC|LLC|LTD|CORP|CO\\.?)?)', 1)) AS value FROM c WHERE line <> '' AND place <= 5
          AND len(value) > 3 AND value NOT IN ('CUSTOMER', 'VEHICLE', 'ORDER', 'DATE', 'BILL TO')
        UNION ALL SELECT doc_id, base, 0, place, line FROM c WHERE line <> '' AND place <= 3 AND len(line) > 5 AND capitals > 0.6 AND NOT regexp_matches(line, '[0-9]{{2,}}')
      ), number AS (
        SELECT doc_id, base, bonus, place, nullif(regexp_extract(text, pattern, 1), '') AS value
        FROM t, (VALUES (5, 1, '(?i)invoice\\s*#[:\\s]*([A-Z0-9-]{{5,}})'), (0, 2, '(?i)invoice\\s*(?:no|number)[:\\s]*([A-Z0-9-]{{5,}})'), (-5, 3, '(?i)order\\s*#[:\\s]*(\\d{{5,}})'), (-15, 4, '(?i)#[:\\s]*([A-Z0-9]{{5,}})')) p(bonus, place, pattern)
        WHERE regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '^\\d{{2}}[-/]\\d{{2}}[-/]\\d{{2,4}}')
      ), written AS (
        SELECT doc_id, base, 10 AS bonus, 0 AS place, regexp_extract(text, '(?i)(?:date|invoice date|dated)[:\\s]*(\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{2,4}})', 1) AS v FROM t
        UNION ALL SELECT doc_id, base, 0, generate_subscripts(found, 1), unnest(found) FROM (SELECT *, list_concat(regexp_extract_all(text, '\\b(\\d{{2}}[-/]\\d{{2}}[-/]\\d{{4}})\\b', 1), regexp_extract_all(text, '\\b(\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}})\\b', 1)) AS found FROM t)
      ), dates AS (
        SELECT doc_id, base, bonus, place, strftime(list_filter([{_FORMATS}], lambda d: year(d) BETWEEN 2000 AND 2030)[1], '%Y-%m-%d') AS value FROM written
      ), total AS (
        SELECT doc_id, base, 15 AS bonus, place, CASE WHEN regexp_matches(value, '[0-9]') THEN value END AS value FROM (SELECT doc_id, base, place, replace(regexp_extract(text, pattern, 1), ',', '') AS value
          FROM t, (VALUES (1, '(?i)(?:invoice total|balance due|amount due|total due)[:\\s]*\\$?\\s*([\\d,]+\\.?\\d*)'), (2, '(?i)total\\s*\\(usd\\)[:\\s]*\\$?\\s*([\\d,]+\\.?\\d*)')) p(place, pattern))
        UNION ALL SELECT doc_id, base, 10, n, nullif(replace(regexp_extract(line, '(?i)\\btotal[:\\s]*\\$?\\s*([\\d,]+\\.\\d{{2}})', 1), ',', ''), '') FROM c WHERE NOT regexp_matches(line, '(?i)(labor|parts|tax)\\s+total')
      ), every AS (
        SELECT 'vendor_name' AS field, * FROM vendor UNION ALL SELECT 'invoice_number', * FROM number UNION ALL SELECT 'invoice_date', * FROM dates UNION ALL SELECT 'total_amount', * FROM total
        UNION ALL SELECT 'po_number', doc_id, base, 0, 0, nullif(regexp_extract(text, '(?i)(?:po|p\\.o\\.|purchase order)\\s*#?[:\\s]*([A-Z0-9-]{{4,}})', 1), '') FROM t
      ), best AS (
        SELECT doc_id, field, value, least(base + bonus, 100) AS confidence FROM every WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY bonus DESC, place) = 1
      )
      SELECT doc_id, field, value, confidence :: DOUBLE AS confidence FROM best UNION ALL SELECT doc_id, 'currency', {_LADDER}, 95.0 FROM t""",
}
