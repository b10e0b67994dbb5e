"""Queries of the scalar rules over rendered documents and the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.operators import labels
from fieldloom.plans import render
from fieldloom.plans.sql import DOCUMENTS
from fieldloom.session import table


def decimal_normalize(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("amount_text")
    return render.documents(spark, folder).select(
        "doc_id", "amount_text", money.decimal_format(amount).alias("format"), F.round(money.decimal_value(amount), 2).alias("amount")
    )


def decimal_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Formats of line prices written with 0 to 3 decimals after either mark."""
    key = F.col("l_orderkey") + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    mark = F.when(key % 2 == 0, ".").otherwise(",")
    units, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 1000).cast("string"), 3, "0")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", key.alias("key"), units.alias("units"), rest.alias("rest"), mark.alias("mark"))
    written = F.when(F.col("key") % 5 == 0, F.col("units")).otherwise(
        F.concat("units", "mark", F.expr("substring(rest, 1, cast(key % 4 as int))"))
    )
    return rows.select("l_orderkey", "l_linenumber", written.alias("written")).select(
        "l_orderkey", "l_linenumber", "written", money.decimal_format(F.col("written")).alias("format"), money.decimal_value(F.col("written")).alias("value")
    )


def date_clean(spark: SparkSession, folder: str) -> DataFrame:
    return render.documents(spark, folder).select("doc_id", "date_text", dates.cleaned(F.col("date_text")).alias("iso"))


def date_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Days up to 39 in month-first dates, held to the end of the month."""
    raw = F.concat_ws("/", F.date_format("o_orderdate", "MM"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"), F.date_format("o_orderdate", "yyyy"))
    return table(spark, folder, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", "raw", dates.cleaned(F.col("raw")).alias("iso"))


def number_validate(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("Invoice: "), k.cast("string")))
        .when(k % 5 == 1, F.date_format("o_orderdate", "yyyyMMdd"))
        .when(k % 5 == 2, F.concat(F.lit("INV-"), k.cast("string")))
        .when(k % 5 == 3, F.date_format("o_orderdate", "dd-MM-yyyy"))
        .otherwise(F.lit("draft"))
    )
    checked = text.number_pattern(F.col("raw"))
    return table(spark, folder, "orders").select(k, raw.alias("raw")).select(
        "o_orderkey", "raw", text.number_clean(F.col("raw")).alias("cleaned"), checked["valid"].alias("valid"), checked["reason"].alias("reason")
    )


def po_validate(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("PO #: "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("P.O. "), F.col("p_brand"))).otherwise(k.cast("string"))
    return table(spark, folder, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", text.po_clean(F.col("raw")).alias("po"))


def currency_infer(spark: SparkSession, folder: str) -> DataFrame:
    found = text.currency_infer(F.col("amount_text"), F.lit(""))
    shown = text.currency_infer(F.lit(""), F.concat(F.lit("Paid in "), F.element_at(F.array(*map(F.lit, ("euro", "cad", "Sterling", "A$", "stones"))), (F.col("doc_id") % 5 + 1).cast("int"))))
    return render.documents(spark, folder).select(
        "doc_id", found["code"].alias("code"), found["confidence"].alias("confidence"), shown["code"].alias("text_code"), shown["confidence"].alias("text_confidence")
    )


def vendor_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat("s_name", F.element_at(F.array(*map(F.lit, (" Corp.", " GmbH", ", Inc", " and Sons Ltd", " Receipt"))), (k % 5 + 1).cast("int")))
    return table(spark, folder, "supplier").select("s_suppkey", name.alias("name")).select(
        "s_suppkey", "name", text.vendor_key(F.col("name")).alias("vendor_key"), text.fingerprint(F.col("name")).alias("fingerprint")
    )


def amount_magnitude(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("o_totalprice") - F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") * 2).otherwise(0)
    found = money.plausibility(F.col("amount"))
    return table(spark, folder, "orders").select("o_orderkey", F.round(amount, 2).alias("amount")).select(
        "o_orderkey", "amount", money.magnitude(F.col("amount")).alias("magnitude"), found["ok"].alias("ok"), found["code"].alias("code")
    )


def round_number(spark: SparkSession, folder: str) -> DataFrame:
    """Orders rounded to fifties against the sum of their items."""
    items = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("items_sum"))
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.round(F.col("o_totalprice") / 50) * 50).otherwise(F.round("o_totalprice", 2))
    return table(spark, folder, "orders").join(items, "o_orderkey", "left").select(
        "o_orderkey", amount.alias("amount"), money.round_suspicion(amount, F.col("items_sum")).alias("suspicion")
    )


def date_consistency(spark: SparkSession, folder: str) -> DataFrame:
    due = F.date_format(F.date_add("o_orderdate", (F.col("o_orderkey") % 250 - 20).cast("int")), "yyyy-MM-dd")
    return table(spark, folder, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), due.alias("due")).select(
        "o_orderkey", "date", "due", dates.consistency(F.col("date"), F.col("due"), F.lit("2000-01-01").cast("timestamp")).alias("finding")
    )


def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    confidence = (F.col("o_orderkey") % 101).cast("double")
    return (
        table(spark, folder, "orders")
        .select(money.bands(confidence, 95, 85).alias("indicator"), money.bands(confidence, 85, 70).alias("badge"))
        .groupBy("indicator", "badge")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


def json_field_text(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of JSON text per event type."""
    return (
        table(spark, folder, "events")
        .select("event_type", F.map_keys(F.from_json("props", "map<string,string>")).alias("keys"))
        .select("event_type", F.explode("keys").alias("key"))
        .groupBy("event_type", "key")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def semantic_label_match(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector's best of the first vectors of all labels."""
    vectors = table(spark, folder, "embeddings")
    words = vectors.groupBy(F.col("label").alias("field")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    found = labels.nearest(vectors.select(F.col("vec_id").alias("line_id"), F.col("embedding").alias("vector")), words)
    return found.select(F.col("line_id").alias("vec_id"), F.col("field").alias("matched"), "score", (F.col("score") >= labels.MEANING).alias("accepted"))


def value_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of four values of every order, counted."""
    k = F.col("o_orderkey")
    values = F.array(
        F.struct(F.lit("invoice_number").alias("field"), F.concat(F.lit("INV-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), k.cast("string")).alias("value")),
        F.struct(F.lit("invoice_date").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("currency").alias("field"), F.when(k % 2 == 0, "USD").otherwise("usd").alias("value")),
        F.struct(F.lit("total_amount").alias("field"), F.floor("o_totalprice").cast("string").alias("value")),
    )
    return (
        table(spark, folder, "orders")
        .select(F.explode(values).alias("v"))
        .select("v.field", text.field_type(F.col("v.field")).alias("field_type"), text.shape(F.col("v.value")).alias("shape"))
        .groupBy("field", "field_type", "shape")
        .agg(F.count(F.lit(1)).alias("values"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        decimal_normalize, decimal_formats, date_clean, date_repair, number_validate, po_validate, currency_infer, vendor_fingerprint,
        amount_magnitude, round_number, date_consistency, confidence_bands, json_field_text, semantic_label_match, value_profile,
    )
}

_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_KEY = "lower(name)"
for _p in (r"\s*corp\.?", r"\s*corporation", r"\s*inc\.?", r"\s*incorporated", r"\s*llc", r"\s*ltd\.?", r"\s*limited", r"\s*co\.?", r"\s*company",
           r"\s*receipt", r"\s*invoice", r"\s*bill", r"[^a-z0-9\s]", r"\s+"):
    _KEY = f"regexp_replace({_KEY}, '{_p}', '', 'g')"
for _w in ("the", "and", "of", "for", "at", "in", "on"):
    _KEY = f"replace({_KEY}, '{_w}', '')"

ORACLES = {
    "decimal_normalize": f"""WITH {DOCUMENTS} SELECT doc_id, amount_text,
        CASE doc_id % 4 WHEN 0 THEN CASE WHEN cents >= 100000 THEN 'us' ELSE 'us_period' END
          WHEN 1 THEN CASE WHEN cents >= 100000 THEN 'european_period_thousands' ELSE 'european_comma' END
          WHEN 2 THEN 'us_period' ELSE 'european_comma' END AS format, round(cents / 100.0, 2) :: DOUBLE AS amount FROM docs""",
    "decimal_formats": """WITH w AS (SELECT l_orderkey, l_linenumber, l_orderkey + l_linenumber AS key, round(l_extendedprice * 100) :: BIGINT AS cents FROM lineitem),
      v AS (SELECT *, (cents // 100) :: VARCHAR AS units, substr(lpad((cents % 1000) :: VARCHAR, 3, '0'), 1, key % 4) AS rest FROM w),
      t AS (SELECT *, CASE WHEN key % 5 = 0 THEN units ELSE units || CASE WHEN key % 2 = 0 THEN '.' ELSE ',' END || rest END AS written FROM v)
      SELECT l_orderkey, l_linenumber, written,
        CASE WHEN key % 5 = 0 THEN 'no_separator' WHEN key % 4 IN (0, 1) THEN 'ambiguous'
             WHEN key % 2 = 0 THEN CASE WHEN key % 4 = 2 THEN 'us_period' ELSE 'european_no_decimals' END
             ELSE CASE WHEN key % 4 = 2 THEN 'european_comma' ELSE 'us_no_decimals' END END AS format,
        CASE WHEN key % 5 = 0 THEN units :: DOUBLE WHEN key % 4 = 3 THEN (units || rest) :: DOUBLE ELSE replace(written, ',', '.') :: DOUBLE END AS value
      FROM t""",
    "date_clean": f"""WITH {DOCUMENTS}, p AS (SELECT doc_id, date_text, o_orderdate FROM docs JOIN orders ON doc_id = o_orderkey)
      SELECT doc_id, date_text, CASE WHEN doc_id % 5 = 2 AND day(o_orderdate) <= 12
        THEN strftime(o_orderdate, '%Y-%d-%m') ELSE {_ISO} END AS iso FROM p""",
    "date_repair": """SELECT o_orderkey, raw, CASE WHEN d = 0 THEN strftime(first, '%Y-%m') || '-00'
        ELSE strftime(least(d, day(last_day(first))) * INTERVAL 1 DAY + first - INTERVAL 1 DAY, '%Y-%m-%d') END AS iso
      FROM (SELECT o_orderkey, o_orderkey % 40 AS d, date_trunc('month', o_orderdate) :: DATE AS first,
        strftime(o_orderdate, '%m') || '/' || lpad((o_orderkey % 40) :: VARCHAR, 2, '0') || '/' || strftime(o_orderdate, '%Y') AS raw FROM orders)""",
    "number_validate": """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Invoice: ' || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
        WHEN 2 THEN 'INV-' || o_orderkey WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'draft' END AS raw FROM orders),
      c AS (SELECT *, regexp_replace(raw, '^(?:invoice|order|#|no\\.?)[\\s:]+', '', 'i') AS bare FROM r)
      SELECT o_orderkey, raw, CASE WHEN bare SIMILAR TO '.*[0-9].*' AND NOT regexp_matches(bare, '^[0-9]{2}[-/][0-9]{2}[-/][0-9]{2,4}$') AND len(bare) BETWEEN 4 AND 30 THEN bare END AS cleaned,
        o_orderkey % 5 IN (0, 2, 3) AS valid, CASE WHEN o_orderkey % 5 = 1 THEN 'date of 8 digits' WHEN o_orderkey % 5 = 4 THEN 'no digit' ELSE 'valid' END AS reason FROM c""",
    "po_validate": """WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PO #: ' || p_partkey WHEN 1 THEN 'P.O. ' || p_brand ELSE p_partkey :: VARCHAR END AS raw FROM part),
      c AS (SELECT *, regexp_replace(raw, '^(?:po|p\\.o\\.|purchase order)\\s*#?\\s*:?\\s*', '', 'i') AS bare FROM r)
      SELECT p_partkey, raw, CASE WHEN len(bare) >= 4 AND regexp_matches(bare, '[A-Za-z0-9]{4,}') THEN bare END AS po FROM c""",
    "currency_infer": """SELECT o_orderkey AS doc_id, 'USD' AS code, CASE WHEN o_orderkey % 4 = 0 THEN 95.0 ELSE 50.0 END :: DOUBLE AS confidence,
        ['EUR', 'CAD', 'GBP', 'USD', 'USD'][o_orderkey % 5 + 1] AS text_code, [75.0, 90.0, 75.0, 95.0, 50.0][o_orderkey % 5 + 1] :: DOUBLE AS text_confidence FROM orders""",
    "vendor_fingerprint": f"""WITH n AS (SELECT s_suppkey, s_name || [' Corp.', ' GmbH', ', Inc', ' and Sons Ltd', ' Receipt'][s_suppkey % 5 + 1] AS name FROM supplier),
      k AS (SELECT s_suppkey, name, {_KEY} AS vendor_key FROM n)
      SELECT *, CASE WHEN vendor_key <> '' THEN substr(sha256(vendor_key), 1, 16) END AS fingerprint FROM k""",
    "amount_magnitude": """WITH a AS (SELECT o_orderkey, round(CASE WHEN o_orderkey % 13 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) AS amount FROM orders),
      c AS (SELECT *, CASE WHEN amount < 0 THEN 'credit' WHEN amount = 0 THEN 'no_charge' WHEN amount > 0.01 AND amount < 10 THEN 'small'
        WHEN amount > 10000 AND amount = floor(amount) THEN 'large_whole' WHEN amount > 100000 THEN 'high' END AS code FROM a)
      SELECT o_orderkey, amount, CASE WHEN amount = 0 THEN 'zero' WHEN abs(amount) < 1 THEN 'fractional' WHEN abs(amount) < 100 THEN 'tens' WHEN abs(amount) < 1000 THEN 'hundreds'
        WHEN abs(amount) < 10000 THEN 'thousands' WHEN abs(amount) < 100000 THEN 'ten_thousands' WHEN abs(amount) < 1000000 THEN 'hundred_thousands' ELSE 'millions_plus' END AS magnitude,
        coalesce(code NOT IN ('small', 'large_whole', 'high'), true) AS ok, code FROM c""",
    "round_number": """WITH i AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS items_sum FROM lineitem GROUP BY l_orderkey),
      a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice / 50) * 50 ELSE round(o_totalprice, 2) END AS amount, items_sum FROM orders LEFT JOIN i ON l_orderkey = o_orderkey)
      SELECT o_orderkey, amount, CASE WHEN amount % 50 = 0 AND items_sum IS NOT NULL AND CASE WHEN amount > 0 THEN abs(amount - items_sum) / amount * 100 ELSE 0 END > 10 THEN 'differs_from_items'
        WHEN amount % 100 = 0 AND amount >= 1000 THEN 'very_round' END AS suspicion FROM a""",
    "date_consistency": f"""WITH d AS (SELECT o_orderkey, {_ISO} AS date, strftime(o_orderdate :: DATE + (o_orderkey % 250 - 20) :: INT, '%Y-%m-%d') AS due FROM orders)
      SELECT *, CASE WHEN date :: DATE > DATE '2000-01-01' THEN 'future' WHEN date_diff('day', date :: DATE, DATE '2000-01-01') / 365.0 > 5 THEN 'older_than_5_years'
        WHEN due < date THEN 'due_before_invoice' WHEN date_diff('day', date :: DATE, due :: DATE) > 180 THEN 'terms_over_180_days' END AS finding FROM d""",
    "confidence_bands": """WITH c AS (SELECT o_orderkey % 101 AS c FROM orders)
      SELECT CASE WHEN c >= 95 THEN 'high' WHEN c >= 85 THEN 'medium' ELSE 'low' END AS indicator,
        CASE WHEN c >= 85 THEN 'high' WHEN c >= 70 THEN 'medium' ELSE 'low' END AS badge, count(*) AS documents FROM c GROUP BY ALL""",
    "json_field_text": "SELECT event_type, key, count(*) AS events FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "semantic_label_match": """WITH w AS (SELECT label AS word_label, arg_min(embedding, vec_id) AS word FROM embeddings GROUP BY label),
      s AS (SELECT vec_id, word_label, round(list_cosine_similarity(embedding :: DOUBLE[], word :: DOUBLE[]), 6) AS score FROM embeddings, w)
      SELECT vec_id, arg_min(word_label, (-score, word_label)) AS matched, max(score) AS score, max(score) >= 0.65 AS accepted FROM s GROUP BY vec_id""",
    "value_profile": f"""WITH v AS (
        SELECT 'invoice_number' AS field, 'INV-' || strftime(o_orderdate, '%Y') || '-' || o_orderkey AS value FROM orders
        UNION ALL SELECT 'invoice_date', {_ISO} FROM orders
        UNION ALL SELECT 'currency', CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'usd' END FROM orders
        UNION ALL SELECT 'total_amount', floor(o_totalprice) :: BIGINT :: VARCHAR FROM orders)
      SELECT field, CASE field WHEN 'invoice_number' THEN 'identifier' WHEN 'invoice_date' THEN 'date' WHEN 'currency' THEN 'currency' ELSE 'monetary' END AS field_type,
        CASE WHEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date_iso' WHEN regexp_matches(value, '^[A-Z]{{2,5}}-[0-9]{{4,}}-[0-9]{{2,}}$') THEN 'invoice_standard'
          WHEN regexp_matches(value, '^-[0-9]+') THEN 'invoice_broken_prefix' WHEN regexp_matches(value, '^[0-9]+$') THEN 'numeric_only' WHEN regexp_matches(value, '^[A-Z]{{3}}$') THEN 'currency_code'
          WHEN regexp_matches(value, '[a-zA-Z]') AND regexp_matches(value, '[0-9]') THEN 'alphanumeric' ELSE 'text' END AS shape, count(*) AS "values" FROM v GROUP BY ALL""",
}
