"""Queries of the vendor, template, validation and serving operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import serve, templates, validate, vendors
from fieldloom.plans import render
from fieldloom.plans.sql import CORRECTIONS, DOCUMENTS
from fieldloom.session import table


def _shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as documents of their supplier."""
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    items = table(spark, folder, "lineitem").join(names, "l_suppkey")
    return items.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("doc_id"),
        F.concat("s_name", F.when(F.col("l_linenumber") % 2 == 0, " Corp.").otherwise("")).alias("vendor_name"),
        F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(101)).cast("double").alias("confidence"),
        F.col("l_shipdate").alias("seen_at"),
        "l_suppkey",
    )


def _vendors(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three suppliers as known vendors."""
    known = table(spark, folder, "supplier").where("s_suppkey % 3 <> 0")
    return known.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("vendor_name"),
        vendors.text.fingerprint(F.col("s_name")).alias("vendor_fingerprint"),
        F.lit(60.0).alias("confidence"),
        F.lit(1).alias("invoice_count"),
        F.lit("1990-01-01").cast("timestamp").alias("last_seen"),
    )


def _listed(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(time, F.date_format(time, "yyyy-MM-dd"))


def vendor_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(vendors.upserted(_vendors(spark, folder), _shipments(spark, folder)), "last_seen")


def vendor_state(spark: SparkSession, folder: str) -> DataFrame:
    return _listed(vendors.state(_shipments(spark, folder)), "last_seen")


def vendor_match(spark: SparkSession, folder: str) -> DataFrame:
    found = vendors.matched(_shipments(spark, folder), _vendors(spark, folder))
    return found.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("documents"))


def vendor_antijoin_new(spark: SparkSession, folder: str) -> DataFrame:
    return vendors.unknown(_shipments(spark, folder), _vendors(spark, folder))


def vendor_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = _shipments(spark, folder).select(F.col("l_suppkey").alias("vendor_id"), F.col("confidence").alias("overall_confidence"))
    owners = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))
    return vendors.statistics(owners, docs)


def sequence_gap(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("vendor_id"),
        F.col("o_orderdate").alias("invoice_date"),
        F.concat(F.lit("INV-2024-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
    )
    return vendors.sequence_gaps(docs)


def template_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    out = templates.rebuilt(render.corrections(spark, folder))
    return out.select(
        "vendor_id",
        "field",
        F.array_join("examples", ",").alias("examples"),
        "occurrences",
        *[F.round(F.col("bbox")[i], 4).alias(f"b{i}") for i in range(4)],
        "page_number",
    )


def template_stats(spark: SparkSession, folder: str) -> DataFrame:
    return templates.statistics(templates.rebuilt(render.corrections(spark, folder)))


def corruption_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' totals and numbers against profiles of plain values."""
    k = F.col("o_orderkey")
    amount = F.when(k % 5 == 0, F.concat(F.lit("2024"), F.floor("o_totalprice").cast("string"))).when(k % 7 == 0, F.concat(F.lit("-"), F.floor("o_totalprice").cast("string"))).otherwise(F.floor("o_totalprice").cast("string"))
    number = F.when(k % 4 == 0, F.concat(F.lit("-2024-"), k.cast("string"))).when(k % 4 == 1, k.cast("string")).otherwise(F.concat(F.lit("INV-2024-"), k.cast("string")))
    plain = {"total_amount": "120", "invoice_number": "INV-2024-00"}
    expected = {f: templates.profile(F.lit(f), F.lit(v)) for f, v in plain.items()}
    return table(spark, folder, "orders").select("o_orderkey", amount.alias("amount"), number.alias("number")).select(
        "o_orderkey",
        "amount",
        "number",
        F.array_join(templates.corruption(F.col("amount"), expected["total_amount"]), ",").alias("amount_codes"),
        F.array_join(templates.corruption(F.col("number"), expected["invoice_number"]), ",").alias("number_codes"),
    )


def template_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Orders' totals checked against their customer's first one."""
    fields = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("vendor_id"), F.lit("total_amount").alias("field"),
        F.floor("o_totalprice").cast("string").alias("value"), (F.lit(70.0) + F.col("o_orderkey") % 31).alias("confidence"),
    )
    template = fields.groupBy("vendor_id", "field").agg(F.min_by("value", "doc_id").alias("example")).where("vendor_id % 2 = 0").select(
        "vendor_id", "field", templates.profile(F.col("field"), F.col("example")).alias("expected")
    )
    return templates.applied(fields, template)


def template_lacking(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as documents of their number, which have a click but no other field of the template."""
    docs = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("vendor_id"))
    fields = docs.select("doc_id", F.lit("click").alias("field"), F.when(F.col("doc_id") % 2 == 0, "1.00").alias("value"))
    return templates.lacking(docs, fields, templates.rebuilt(render.corrections(spark, folder)))


def line_items_vs_total(spark: SparkSession, folder: str) -> DataFrame:
    totals = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round("o_totalprice", 2).alias("total"))
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return validate.items_against_total(totals, items).withColumns({c: F.col(c).cast("double") for c in ("items_sum", "difference")})


def document_type(spark: SparkSession, folder: str) -> DataFrame:
    found = validate.document_type(F.col("text"), F.when(F.col("doc_id") % 13 == 0, F.lit(-1.0)).otherwise(F.lit(1.0)))
    return render.documents(spark, folder).select("doc_id", found["kind"].alias("kind"), found["confidence"].alias("confidence"))


def decimal_error_from_text(spark: SparkSession, folder: str) -> DataFrame:
    """Totals that lost their comma, found again in the text."""
    amount = F.when(F.col("doc_id") % 2 == 1, F.col("cents").cast("double")).otherwise(F.col("cents") / 100)
    return render.documents(spark, folder).select("doc_id", F.round(validate.misread_amount(amount, F.col("amount_text")), 2).alias("suggested"))


def _raw_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Raw fields of rendered documents, some unreadable, swapped or missing."""
    k = F.col("doc_id")
    dated = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format(F.date_add("o_orderdate", 30), "MM/dd/yyyy").alias("later"))
    due = F.when(k % 4 == 1, "NET 30 DAYS").when(k % 4 == 2, F.col("later")).when(k % 4 == 3, "November 35x")
    given = {"vendor_name": 65 + k % 30, "invoice_number": 80 + k % 20, "invoice_date": 75 + k % 25, "due_date": F.when(k % 4 != 0, 60 + k % 35), "total_amount": 82 + k % 18, "currency": F.lit(90)}
    return render.documents(spark, folder).join(dated, "doc_id").select(
        "doc_id",
        F.concat("text", F.when(k % 6 == 2, "\nBill To: Blue Harbor Works").otherwise("")).alias("text"),
        F.when(k % 6 == 0, "Acme Ltd").when(k % 6 == 1, "John Smith").when(k % 6 == 2, "Blue Harbor Works").otherwise("Northern Trading Co").alias("vendor_name"),
        F.lit("Acme Ltd").alias("customer_name"),
        F.when(k % 9 == 0, F.lit("n/a")).otherwise(F.concat(F.when(k % 9 == 1, "#: INV-").otherwise("INV-"), k.cast("string"))).alias("invoice_number"),
        F.when(k % 8 == 0, "unreadable").otherwise(F.col("date_text")).alias("invoice_date"),
        due.alias("due_date"),
        F.col("amount_text").alias("total_text"),
        F.when(k % 3 == 1, "eur").when(k % 3 == 2, "xyz").alias("currency"),
        F.create_map(*[x for f, c in given.items() for x in (F.lit(f), c.cast("double"))]).alias("confidences"),
    )


def validation_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return validate.validated(_raw_fields(spark, folder), F.lit("2000-01-01").cast("timestamp"))


def cross_field_validation(spark: SparkSession, folder: str) -> DataFrame:
    """The same fields with order lines or one item as items, known vendors and order numbers."""
    k = F.col("doc_id")
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.round("l_extendedprice", 2).alias("amount")).where(k % 3 == 1)
    single = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.round("o_totalprice", 2).alias("amount")).where(k % 3 == 0)
    names = F.when(k % 4 == 1, " northern TRADING").when(k % 4 == 2, "Zenith Ltd").when(k % 4 == 3, "Acme Ltd")
    known = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id")).select("doc_id", names.alias("vendor_name"))
    fields = validate.with_items_and_vendors(_raw_fields(spark, folder), lines.unionByName(single), known)
    number = F.when(k % 2 == 0, F.concat(F.lit("PO #: "), k.cast("string")))
    checked = validate.validated(fields.withColumn("po_number", number), F.lit("2000-01-01").cast("timestamp"))
    return checked.select("doc_id", "codes", "corrections", "needs_review", "items_difference", "po_number")


def _served(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("vendor_name"))
    status = F.element_at(F.create_map(F.lit("F"), F.lit("EXTRACTED"), F.lit("O"), F.lit("PROCESSING"), F.lit("P"), F.lit("FAILED")), F.col("o_orderstatus"))
    return table(spark, folder, "orders").join(names, "o_custkey").select(
        F.col("o_orderkey").alias("doc_id"),
        "vendor_name",
        status.alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"),
        F.when(F.col("o_orderkey") % 10 != 0, (F.lit(50) + F.col("o_orderkey") % 50).cast("double")).alias("overall_confidence"),
    )


def invoice_list_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page is the feature here, so it has a limit."""
    return serve.listed(_served(spark, folder), page=2, limit=20, status="EXTRACTED", min_confidence=80.0)


def dashboard_stats(spark: SparkSession, folder: str) -> DataFrame:
    return serve.statistics(_served(spark, folder))


def page_count(spark: SparkSession, folder: str) -> DataFrame:
    return serve.page_count(_served(spark, folder))


def status_progress(spark: SparkSession, folder: str) -> DataFrame:
    return _served(spark, folder).select("doc_id", "status", serve.progress(F.col("status")).alias("progress"))


QUERIES = {
    f.__name__: f
    for f in (
        vendor_upsert, vendor_state, vendor_match, vendor_antijoin_new, vendor_stats, sequence_gap, template_rebuild, template_stats, corruption_flags,
        template_apply, template_lacking, line_items_vs_total, document_type, decimal_error_from_text, validation_pipeline, cross_field_validation, invoice_list_page, dashboard_stats,
        page_count, status_progress,
    )
}

_VENDOR_KEY = "lower(replace(replace({}, '#', ''), ' Corp.', ''))"
_SHIPMENTS = """ship AS (
  SELECT l_orderkey * 8 + l_linenumber AS doc_id, s_name || CASE WHEN l_linenumber % 2 = 0 THEN ' Corp.' ELSE '' END AS vendor_name,
    ((l_orderkey * 7 + l_linenumber) % 101) :: DOUBLE AS confidence, l_shipdate AS seen_at, l_suppkey,
    substr(sha256(lower(replace(s_name, '#', ''))), 1, 16) AS vendor_fingerprint
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), state AS (
  SELECT vendor_fingerprint, arg_min(vendor_name, (-confidence, seen_at, doc_id)) AS vendor_name, max(confidence) AS confidence, count(*) :: INT AS invoice_count, max(seen_at) AS last_seen
  FROM ship WHERE confidence >= 10 GROUP BY vendor_fingerprint
), known AS (
  SELECT s_suppkey AS id, s_name, substr(sha256(lower(replace(s_name, '#', ''))), 1, 16) AS vendor_fingerprint FROM supplier WHERE s_suppkey % 3 <> 0
)"""
_SERVED = """served AS (SELECT o_orderkey AS doc_id, c_name AS vendor_name, CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'PROCESSING' WHEN 'P' THEN 'FAILED' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CASE WHEN o_orderkey % 10 <> 0 THEN (50 + o_orderkey % 50) :: DOUBLE END AS overall_confidence
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
_CORRUPT = """c AS (SELECT *, CASE WHEN abs(v) < 100 THEN 1 WHEN abs(v) < 1000 THEN 2 WHEN abs(v) < 10000 THEN 3 WHEN abs(v) < 100000 THEN 4 WHEN abs(v) < 1000000 THEN 5 ELSE 6 END AS level FROM v)"""

ORACLES = {
    "vendor_state": f"WITH {_SHIPMENTS} SELECT * REPLACE (strftime(last_seen, '%Y-%m-%d') AS last_seen) FROM state",
    "vendor_upsert": f"""WITH {_SHIPMENTS} SELECT vendor_fingerprint, CASE WHEN coalesce(n.confidence > 60, k.id IS NULL) THEN n.vendor_name ELSE k.s_name END AS vendor_name,
        CASE WHEN coalesce(n.confidence > 60, k.id IS NULL) THEN n.confidence ELSE 60 END :: DOUBLE AS confidence,
        (coalesce(n.invoice_count, 0) + CASE WHEN k.id IS NULL THEN 0 ELSE 1 END) :: INT AS invoice_count,
        strftime(coalesce(n.last_seen, TIMESTAMP '1990-01-01'), '%Y-%m-%d') AS last_seen
      FROM state n FULL JOIN known k USING (vendor_fingerprint)""",
    "vendor_match": f"WITH {_SHIPMENTS} SELECT id AS vendor_id, count(*) AS documents FROM ship LEFT JOIN known USING (vendor_fingerprint) GROUP BY id",
    "vendor_antijoin_new": f"""WITH {_SHIPMENTS} SELECT vendor_fingerprint, arg_min(vendor_name, (seen_at, doc_id)) AS vendor_name, count(*) AS documents
      FROM ship ANTI JOIN known USING (vendor_fingerprint) WHERE confidence >= 10 GROUP BY vendor_fingerprint""",
    "vendor_stats": f"""WITH {_SHIPMENTS} SELECT s_suppkey AS vendor_id, s_name AS vendor_name, count(doc_id) AS documents, round(avg(confidence), 2) AS average_confidence
      FROM supplier LEFT JOIN ship ON l_suppkey = s_suppkey GROUP BY ALL""",
    "sequence_gap": """WITH s AS (SELECT o_orderkey AS doc_id, o_custkey AS vendor_id, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders)
      SELECT *, CASE WHEN step < 0 THEN 'decreased' WHEN step > 1000 THEN 'large_gap' END AS warning FROM s""",
    "template_rebuild": f"""WITH {CORRECTIONS},
      v AS (SELECT vendor_id, field_name, corrected_value, max((created_at, id)) AS seen FROM corrections GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, field_name ORDER BY seen DESC) AS place FROM v),
      e AS (SELECT vendor_id, field_name, string_agg(corrected_value, ',' ORDER BY seen) AS examples FROM n WHERE place <= 5 GROUP BY ALL),
      p AS (SELECT vendor_id, field_name, page_number, count(*) AS n, min((created_at, id)) AS seen FROM corrections GROUP BY ALL),
      g AS (SELECT vendor_id, field_name, arg_min(page_number, (-n, seen)) AS page_number FROM p GROUP BY ALL),
      b AS (SELECT vendor_id, field_name, count(*) AS occurrences, round(median(bbox[1]), 4) AS b0, round(median(bbox[2]), 4) AS b1, round(median(bbox[3]), 4) AS b2, round(median(bbox[4]), 4) AS b3
        FROM (SELECT * REPLACE (bbox :: DOUBLE[] AS bbox) FROM corrections) GROUP BY ALL)
      SELECT vendor_id, field_name AS field, examples, occurrences, b0, b1, b2, b3, page_number FROM e JOIN b USING (vendor_id, field_name) JOIN g USING (vendor_id, field_name)""",
    "template_stats": f"""WITH {CORRECTIONS}, f AS (SELECT vendor_id, field_name, count(*) AS n, least(5, count(DISTINCT corrected_value)) :: INT AS e FROM corrections GROUP BY ALL)
      SELECT vendor_id, count(*) AS fields, sum(n) :: BIGINT AS occurrences, max(e) AS most_examples FROM f GROUP BY vendor_id""",
    "corruption_flags": f"""WITH t AS (SELECT o_orderkey, o_orderkey AS k, floor(o_totalprice) :: BIGINT AS p FROM orders),
      v AS (SELECT *, CASE WHEN k % 5 = 0 THEN '2024' || p WHEN k % 7 = 0 THEN '-' || p ELSE p :: VARCHAR END AS amount,
        CASE k % 4 WHEN 0 THEN '-2024-' || k WHEN 1 THEN k :: VARCHAR ELSE 'INV-2024-' || k END AS number,
        (CASE WHEN k % 5 = 0 THEN '2024' || p WHEN k % 7 = 0 THEN '-' || p ELSE p :: VARCHAR END) :: BIGINT AS v FROM t), {_CORRUPT}
      SELECT o_orderkey, amount, number, concat_ws(',', CASE WHEN v < 0 THEN 'negative' END, CASE WHEN len(abs(v) :: VARCHAR) > 5 THEN 'too_many_digits' END,
        CASE WHEN v <> 0 AND abs(level - 2) > 2 THEN 'magnitude_jump' END, CASE WHEN regexp_matches(amount, '2023|2024|2025') AND v > 10000 THEN 'year_digits' END) AS amount_codes,
        concat_ws(',', CASE WHEN number[1] = '-' THEN 'missing_prefix' END, CASE WHEN k % 4 = 1 THEN 'format_changed' END, CASE WHEN abs(len(number) - 11) > 5 THEN 'length_mismatch' END) AS number_codes FROM c""",
    "template_apply": f"""WITH t AS (SELECT o_orderkey AS doc_id, o_custkey, floor(o_totalprice) :: BIGINT AS v, 70.0 + o_orderkey % 31 AS confidence FROM orders),
      {_CORRUPT.replace('FROM v)', 'FROM t)')}, x AS (SELECT o_custkey, arg_min(v, doc_id) AS v, arg_min(level, doc_id) AS level FROM c WHERE o_custkey % 2 = 0 GROUP BY o_custkey),
      f AS (SELECT c.doc_id, c.v, c.confidence, x.v IS NOT NULL AS known, concat_ws(',', CASE WHEN len(c.v :: VARCHAR) > len(x.v :: VARCHAR) + 2 THEN 'too_many_digits' END,
        CASE WHEN c.v >= 1 AND x.v >= 1 AND abs(c.level - x.level) > 2 THEN 'magnitude_jump' END,
        CASE WHEN x.v IS NOT NULL AND regexp_matches(c.v :: VARCHAR, '2023|2024|2025') AND c.v > 10000 THEN 'year_digits' END) AS codes FROM c LEFT JOIN x USING (o_custkey))
      SELECT doc_id, 'total_amount' AS field, v :: VARCHAR AS value, (CASE WHEN NOT known THEN confidence WHEN codes <> '' THEN 50 ELSE least(100, confidence + 5) END) :: DOUBLE AS confidence, codes FROM f""",
    "template_lacking": f"""WITH {CORRECTIONS}, v AS (SELECT vendor_id, field_name AS field, arg_max(corrected_value, (created_at, id)) AS suggestion FROM corrections GROUP BY ALL)
      SELECT c_custkey AS doc_id, field, suggestion FROM customer JOIN v ON vendor_id = c_custkey WHERE field <> 'click' OR c_custkey % 2 <> 0""",
    "line_items_vs_total": """WITH i AS (SELECT l_orderkey, sum(l_extendedprice :: DECIMAL(18, 2)) :: DOUBLE AS items_sum, count(*) AS items FROM lineitem GROUP BY l_orderkey),
      j AS (SELECT o_orderkey AS doc_id, round(o_totalprice, 2) AS total, items_sum, items FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)
      SELECT doc_id, total, items_sum, coalesce(items, 0) AS items, coalesce(items, 0) AS readable, round(abs(items_sum - total), 2) AS difference,
        round(CASE WHEN total > 0 THEN abs(total - items_sum) / total * 100 ELSE 0 END, 1) AS percent, coalesce(round(abs(items_sum - total), 2) <= 0.02, true) AS matches FROM j""",
    "document_type": f"""WITH {DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'credit_note' WHEN doc_id % 7 = 0 THEN 'quote' ELSE 'invoice' END AS kind,
        CASE WHEN doc_id % 11 = 0 THEN 90.0 WHEN doc_id % 13 = 0 THEN 85.0 WHEN doc_id % 7 = 0 THEN 90.0 ELSE 95.0 END :: DOUBLE AS confidence FROM docs""",
    "decimal_error_from_text": f"""WITH {DOCUMENTS} SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR (doc_id % 4 = 1 AND cents < 100000) THEN round(cents / 100.0, 2) :: DOUBLE END AS suggested FROM docs""",
    "validation_pipeline": f"""WITH {DOCUMENTS}, r AS (SELECT doc_id, doc_id AS k, date_text, cents, units, high, o.o_orderdate AS ordered, cents / 100.0 :: DOUBLE AS total,
          strftime(o.o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN k % 11 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 THEN 'Invoice' ELSE 'Invoice No: INV-' || strftime(o.o_orderdate, '%Y') || '-' || k END AS company,
          CASE k % 5 WHEN 1 THEN strftime(o.o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o.o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o.o_orderdate, '%Y-%m-') || left(strftime(o.o_orderdate, '%Y'), 2) END AS in_text
          FROM docs JOIN parts USING (doc_id, cents) JOIN orders o ON doc_id = o_orderkey),
      d AS (SELECT *, CASE WHEN k % 8 = 0 THEN in_text WHEN k % 5 = 2 AND day(ordered) <= 12 THEN strftime(ordered, '%Y-%d-%m') ELSE iso END AS date,
          CASE k % 4 WHEN 2 THEN strftime(ordered + INTERVAL 30 DAY, '%Y-%m-%d') WHEN 3 THEN in_text END AS due_date,
          (k % 4 = 3 OR (k % 4 = 1 AND high = 0)) AND abs(total - units :: DOUBLE) < 0.01 :: DOUBLE AS misread FROM r),
      c AS (SELECT *, list_filter([CASE k % 6 WHEN 0 THEN 'vendor_equals_customer' WHEN 1 THEN 'vendor_person' WHEN 2 THEN 'vendor_wrong_section' END, CASE WHEN k % 9 = 0 THEN 'number_invalid' END,
          CASE WHEN date IS NULL THEN 'date_invalid' END, CASE WHEN k % 4 = 3 AND due_date IS NULL THEN 'due_invalid' END,
          CASE WHEN total > 0.01 AND total < 10 THEN 'small' WHEN total > 10000 AND cents % 100 = 0 THEN 'large_whole' WHEN total > 100000 THEN 'high' END, CASE WHEN misread THEN 'decimal_misread' END,
          CASE WHEN date :: DATE > DATE '2000-01-01' THEN 'future' WHEN (DATE '2000-01-01' - date :: DATE) / 365.0 > 5 THEN 'older_than_5_years' WHEN due_date < date THEN 'due_before_invoice'
            WHEN due_date :: DATE - date :: DATE > 180 THEN 'terms_over_180_days' END], lambda x: x IS NOT NULL) AS codes,
        list_filter([CASE WHEN k % 6 IN (1, 2) THEN 'vendor_corrected' END, CASE WHEN k % 9 = 1 THEN 'number_cleaned' END, CASE WHEN k % 8 <> 0 AND k % 5 <> 0 THEN 'date_reformatted' END,
          CASE WHEN k % 8 = 0 AND date IS NOT NULL THEN 'date_from_text' END, CASE WHEN k % 4 = 1 THEN 'terms_from_text' END, CASE WHEN k % 4 = 2 THEN 'due_reformatted' END,
          CASE WHEN k % 4 = 3 AND due_date IS NOT NULL THEN 'due_from_text' END, CASE WHEN misread THEN 'total_corrected' END, CASE WHEN k % 3 = 0 THEN 'currency_inferred' END], lambda x: x IS NOT NULL) AS corrections,
        (CASE WHEN k % 6 < 3 THEN greatest(60, 45 + k % 30) ELSE 65 + k % 30 END + CASE WHEN k % 9 = 0 THEN greatest(70, 65 + k % 20) ELSE 80 + k % 20 END
          + CASE WHEN date IS NULL THEN greatest(30, 25 + k % 25) ELSE 75 + k % 25 END + CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 3 AND due_date IS NULL THEN greatest(30, 10 + k % 35) ELSE 60 + k % 35 END
          + CASE WHEN misread THEN greatest(85, 72 + k % 18) ELSE 82 + k % 18 END + 90) :: DOUBLE / CASE WHEN k % 4 = 0 THEN 5 ELSE 6 END AS mean FROM d),
      o AS (SELECT *, round(greatest(0, mean - least(5 * len(codes), 30)), 2) AS overall_confidence, CASE WHEN k % 11 = 0 THEN 'credit_note' WHEN k % 7 = 0 THEN 'quote' ELSE 'invoice' END AS document_type FROM c)
      SELECT doc_id, CASE k % 6 WHEN 0 THEN 'Acme Ltd' WHEN 1 THEN company WHEN 2 THEN 'Northern Trading ' || o_custkey ELSE 'Northern Trading Co' END AS vendor, CASE WHEN k % 9 <> 0 THEN 'INV-' || k END AS number,
        date, due_date, CASE WHEN k % 4 = 1 THEN 30 END AS payment_terms, total, CASE k % 3 WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency, document_type,
        array_to_string(codes, ',') AS codes, array_to_string(corrections, ',') AS corrections, overall_confidence,
        len(codes) > 0 OR len(list_intersect(corrections, ['total_corrected', 'vendor_corrected', 'date_reformatted'])) > 0 OR overall_confidence < 85 OR document_type = 'credit_note' AS needs_review
      FROM o JOIN (SELECT o_orderkey AS doc_id, o_custkey FROM orders) USING (doc_id)""",
    "invoice_list_page": f"WITH {_SERVED} SELECT * FROM served WHERE status = 'EXTRACTED' AND overall_confidence >= 80 ORDER BY invoice_date DESC, doc_id LIMIT 20 OFFSET 20",
    "dashboard_stats": f"""WITH {_SERVED} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'EXTRACTED') AS processed, count(*) FILTER (WHERE status = 'PROCESSING') AS pending,
        count(*) FILTER (WHERE status = 'FAILED') AS failed, round(sum(coalesce(overall_confidence, 0)) / count(*), 2) AS average_confidence FROM served""",
    "page_count": f"WITH {_SERVED} SELECT count(*) AS total, ceil(count(*) / 20) :: BIGINT AS pages FROM served",
    "status_progress": f"WITH {_SERVED} SELECT doc_id, status, CASE status WHEN 'EXTRACTED' THEN 100 WHEN 'PROCESSING' THEN 50 ELSE 0 END AS progress FROM served",
}

# the codes that need items and a known vendor, after those that the fields have by themselves
ORACLES["cross_field_validation"] = f"""WITH base AS ({ORACLES["validation_pipeline"]}), i AS (
    SELECT doc_id, sum(amount :: DECIMAL(20, 4)) :: DOUBLE AS s FROM (SELECT l_orderkey AS doc_id, round(l_extendedprice, 2) AS amount FROM lineitem WHERE l_orderkey % 3 = 1
      UNION ALL SELECT o_orderkey, round(o_totalprice, 2) FROM orders WHERE o_orderkey % 3 = 0) GROUP BY doc_id
  ), b AS (
    SELECT base.*, s, total AS amount, lower(vendor) AS v,
      CASE doc_id % 4 WHEN 1 THEN 'northern trading' WHEN 2 THEN 'zenith ltd' WHEN 3 THEN 'acme ltd' END AS known FROM base LEFT JOIN i USING (doc_id)
  ), n AS (
    SELECT *, list_filter([CASE WHEN s IS NOT NULL AND amount <> 0 AND round(abs(s - amount), 4) > 0.02 THEN 'items_differ' END,
      CASE WHEN s IS NOT NULL AND amount % 50 = 0 THEN CASE WHEN amount > 0 AND abs(amount - s) / amount * 100 > 10 THEN 'differs_from_items' WHEN amount >= 1000 AND amount % 100 = 0 THEN 'very_round' END END,
      CASE WHEN NOT contains(v, known) AND NOT contains(known, v) THEN 'vendor_mismatch' END], lambda x: x IS NOT NULL) AS more FROM b
  )
  SELECT doc_id, array_to_string(list_filter([codes, array_to_string(more, ',')], lambda x: x <> ''), ',') AS codes,
    array_to_string(list_filter([corrections, CASE WHEN doc_id % 2 = 0 AND doc_id >= 1000 THEN 'po_cleaned' END], lambda x: x <> ''), ',') AS corrections,
    needs_review OR len(list_filter(more, lambda x: x <> 'very_round')) > 0 AS needs_review, round(abs(s - amount), 2) AS items_difference,
    CASE WHEN doc_id % 2 = 0 AND doc_id >= 1000 THEN doc_id :: VARCHAR END AS po_number FROM n"""

