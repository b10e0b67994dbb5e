"""Records under change: refreshed templates, pages put together, open records, submitted corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import records
from fieldloom.functions.text import fixed
from fieldloom.operators import multipage, submit
from fieldloom.plans import render
from fieldloom.plans.sql import CORRECTIONS, DOCUMENTS, TALLY, VOTES
from fieldloom.session import table
from fieldloom.sources import routing, sinks
from fieldloom.streaming import templated

VENDORS = 150
LEAST = 3
#: The field that a kind of event corrects.
FIELDS = {"click": "total_amount", "error": "invoice_number", "purchase": "vendor_name", "view": "currency"}


def _corrections(spark: SparkSession, folder: str) -> DataFrame:
    named = F.create_map(*[F.lit(x) for item in FIELDS.items() for x in item])
    return render.corrections(spark, folder).withColumn("field_name", F.try_element_at(named, F.col("field_name"))).where("field_name is not null")


def template_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Every order's votes with those of its vendor's templates, as a batch of the stream resolves them."""
    votes = render.votes(spark, folder, dealt=True).withColumns(
        {"vendor_id": F.pmod(F.col("doc_id"), F.lit(VENDORS)).cast("long"), "arrived_at": F.lit(None).cast("timestamp")}
    )
    return templated.records(votes, _corrections(spark, folder), LEAST, dealt=None)


def _named_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files of seven kinds, a third of them broken."""
    k, broken = F.col("page_id"), F.col("page_id") % 3 == 0
    part = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    n = k.cast("string")
    kinds = (
        ("csv", F.when(broken, part('page,"', n)).otherwise(part("page,", n, '\n\nlen,"', F.length("html").cast("string"), ',x"\n'))),
        ("json", F.when(broken, part('{"id": ', n)).otherwise(part('{"id": ', n, ', "sub": {"n": [', n, "]}}"))),
        ("txt", F.col("html")),
        ("pdf", F.when(broken, n).otherwise(part("%PDF-", n))),
        ("exe", F.lit("MZ")),
        ("jsonl", F.when(broken, part('{"a": 1}\n[2]\n')).otherwise(part('{"a": 1}\n\n{"b": null}\n'))),
        ("html", F.when(broken, "").otherwise(F.col("html"))),
    )
    chosen = F.element_at(F.array(*[F.struct(F.lit(e).alias("ending"), c.alias("content")) for e, c in kinds]), (k % 7 + 1).cast("int"))
    rows = table(spark, folder, "pages").where("page_id is not null").select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", chosen.alias("f"))
    content = F.col("f.content").cast("binary")
    return rows.select(
        part("in/", n, ".", F.col("f.ending")).alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modificationTime"), F.octet_length(content).cast("long").alias("length"), content.alias("content")
    )


def routed_files(spark: SparkSession, folder: str) -> DataFrame:
    """What each file becomes, with the numbers of its cells, records and characters."""
    rows = routing.routed(_named_files(spark, folder))
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return rows.select(
        "path", "route", "reason", size("cells").alias("cells"), size("records").alias("records"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")
    )


def table_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Customers merged with what their newest order says, a column of which is new."""
    old = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.round("c_acctbal", 2).alias("balance"))
    new = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey", F.round("o_totalprice", 2).alias("balance"), F.col("o_orderstatus").alias("last_status")
    )
    return sinks.merged(old, new, ["key"], ["o_orderdate", "o_orderkey"])


def _open(spark: SparkSession, folder: str) -> DataFrame:
    """Two JSON records of every order, with nulls, lists, no records and missing keys."""
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    left = (
        F.when(k % 11 == 0, F.lit(None))
        .when(k % 7 == 0, "[1]")
        .otherwise(text('{"_page":', k % 4, ',"number":"N-', k, '","total":', F.when(k % 4 == 3, "null").otherwise(cents), ',"vendor":{"id":', F.col("o_custkey"), ',"tags":["x",', k % 3, "]}}"))
    )
    right = text('{"extra":{"k":', k % 9, '},"total":', k, F.when(k % 3 == 0, ',"vendor":null').otherwise(""), "}")
    return table(spark, folder, "orders").select(k.alias("doc_id"), left.alias("l"), right.alias("r"))


def open_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every key of two merged records, what stands at paths, and what is carried along unchecked."""
    left, right = F.col("left"), F.col("right")
    parsed = _open(spark, folder).select("doc_id", records.record(F.col("l")).alias("left"), records.record(F.col("r")).alias("right"))
    each = parsed.select(
        "doc_id",
        records.entries(records.right_wins(left, right)).alias("wins"),
        records.entries(records.left_wins(left, right)).alias("keeps"),
        records.path_get(left, "vendor.tags.1", "int").alias("tag"),
        records.path_set(left, "vendor.seen.at", records.variant(F.col("doc_id"))).alias("marked"),
        F.array_join(F.array_sort(F.map_keys(records.entries(records.carried(right, left, ("total", "vendor"))))), ",").alias("carried"),
    )
    # what holds for a whole document is computed before its keys become rows
    rows = each.select(
        "doc_id", "keeps", "tag", records.path_get(F.col("marked"), "vendor.seen.at", "long").alias("seen_at"), records.path_get(F.col("marked"), "vendor.id", "long").alias("vendor_id"), "carried",
        F.explode("wins").alias("key", "won"),
    )
    return rows.select(
        "doc_id", "key", records.shown(F.col("won")).alias("right_wins"), records.shown(F.col("keeps")[F.col("key")]).alias("left_wins"), "tag", "seen_at", "vendor_id", "carried",
    )


#: Pages of eight orders are one document; with more items or other pages than this it is marked, and its items stand in long form too.
MOST_ITEMS = 40


def _pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, folder, "lineitem")
    doc, page = F.floor(F.col("l_orderkey") / 8).alias("doc_id"), ((F.col("l_orderkey") % 8) * 7 + F.col("l_linenumber")).alias("page")
    rows = line.select(doc, page, "l_suppkey", "l_quantity", F.round("l_extendedprice", 2).alias("price"))
    number = F.when(F.col("page") % 5 != 0, F.concat(F.lit("N-"), F.col("doc_id").cast("string"), F.when((F.col("doc_id") % 3 == 0) & (F.col("page") % 2 == 0), "b").otherwise("")))
    pages = rows.select("doc_id", "page", number.alias("invoice_number"), F.format_string("%.2f", "price").alias("total_amount"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("vendor_name"))
    item = F.explode(F.array(F.lit(1), F.lit(2))).alias("item_no")
    items = rows.select("doc_id", "page", item, "l_quantity", "price").select(
        "doc_id", "page", "item_no", F.lit("part").alias("description"), F.col("l_quantity").alias("quantity"), F.lit(None).cast("double").alias("unit_price"), F.format_string("%.2f", F.col("price") * F.col("item_no")).alias("amount")
    )
    return pages, items


def multipage_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of up to 56 pages with all their items in order and their other pages."""
    pages, items = _pages(spark, folder)
    out = multipage.records(pages, items)
    other = F.array_join(F.transform("other_pages", lambda p: F.concat_ws(":", p["page"].cast("string"), F.coalesce(p["invoice_number"], F.lit("-")), p["vendor_name"])), "\n")
    many = (F.col("n_items") > MOST_ITEMS) | (F.col("n_other_pages") > MOST_ITEMS)
    return out.select("doc_id", "page_count", "multiple_invoices", "invoice_number", "total_amount", "n_items", multipage.concatenated(F.col("line_items")).alias("items"), other.alias("others"), many.alias("overflowed"))


def multipage_overflow(spark: SparkSession, folder: str) -> DataFrame:
    """The items of documents that hold more than a record does, in long form."""
    pages, items = _pages(spark, folder)
    return multipage.overflow(pages, items, MOST_ITEMS).select("doc_id", "place", "page", "item_no", "amount")


def correction_submit(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth document corrected: its record, the anchored corrections and what its vendor's template learns, as rows of one table."""
    k = F.col("doc_id")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"))
    docs = render.documents(spark, folder).join(orders, "doc_id")
    number = F.concat(F.lit("INV-"), F.date_format("submitted_at", "yyyy"), F.lit("-"), k.cast("string"))
    extracted = F.create_map(F.lit("invoice_number"), F.when(k % 2 == 0, number).otherwise("unread"), F.lit("total_amount"), F.lit("0"), F.lit("note"), F.lit("x"))
    documents = docs.select("doc_id", F.when(k % 7 != 0, F.pmod(k, F.lit(VENDORS)).cast("long")).alias("vendor_id"), extracted.alias("extracted_data"), F.lit("EXTRACTED").alias("status"))
    corrected = F.create_map(F.lit("invoice_number"), number, F.lit("total_amount"), F.col("amount_text"), F.lit("currency"), F.lit("EUR"))
    boxes = F.when(k % 3 == 0, F.create_map(F.lit("currency"), F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4)))))
    submissions = docs.where(k % 5 == 0).select("doc_id", corrected.alias("corrected"), boxes.alias("boxes"), F.create_map(F.lit("currency"), F.lit(2)).alias("pages"), "submitted_at")
    template = spark.createDataFrame([], "vendor_id long, field string, examples array<string>, confidence double, occurrences long")
    out = submit.submitted(submissions, documents, render.tokens(spark, folder), template)
    sides = F.array_join(F.transform("bbox", lambda x: fixed(x, 4)), ",")
    text = lambda *x: F.concat_ws("|", *x)
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("extracted_data")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return (
        out["documents"].select(F.lit("document").alias("part"), k.alias("id"), F.lit("").alias("field"), text("status", entries).alias("value"))
        .unionByName(out["corrections"].select(F.lit("correction").alias("part"), k.alias("id"), F.col("field_name").alias("field"),
                                               text(F.coalesce("original_value", F.lit("-")), "corrected_value", F.coalesce(sides, F.lit("-")), F.coalesce(F.col("page").cast("string"), F.lit("-"))).alias("value")))
        .unionByName(out["template"].select(F.lit("template").alias("part"), F.col("vendor_id").alias("id"), "field", text(F.array_join("examples", ";"), F.col("occurrences").cast("string")).alias("value")))
    )


QUERIES = {f.__name__: f for f in (correction_submit, template_refresh, routed_files, table_upsert, open_records, multipage_records, multipage_overflow)}

_NAMED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIELDS.items())
_PAGES = """p AS (
  SELECT l_orderkey // 8 AS doc_id, (l_orderkey % 8) * 7 + l_linenumber AS page, l_suppkey, round(l_extendedprice, 2) AS price, l_quantity FROM lineitem
), each AS (
  SELECT doc_id, page, min((CASE WHEN page % 5 <> 0 THEN 'N-' || doc_id || CASE WHEN doc_id % 3 = 0 AND page % 2 = 0 THEN 'b' ELSE '' END END, printf('%.2f', price), 'S' || l_suppkey)) AS f FROM p GROUP BY ALL
), docs AS (
  SELECT doc_id, count(*) AS page_count, min(page) AS first_page, count(DISTINCT f[1]) = 1 AS single, arg_min(f, page) AS f FROM each GROUP BY doc_id
), items AS (
  SELECT p.doc_id, page, n AS item_no, printf('%.2f', price * n) AS amount, l_quantity FROM p, (VALUES (1), (2)) v(n), docs
  WHERE docs.doc_id = p.doc_id AND (single OR page_count = 1 OR page = first_page)
), counted AS (
  SELECT doc_id, count(*) AS n, string_agg(page || ':' || item_no || ':' || amount, chr(10) ORDER BY page, item_no, l_quantity, amount) AS items FROM items GROUP BY doc_id
), rest AS (
  SELECT doc_id, count(*) AS n, string_agg(page || ':' || coalesce(each.f[1], '-') || ':' || each.f[3], chr(10) ORDER BY page) AS others
  FROM each JOIN docs USING (doc_id) WHERE NOT single AND page_count > 1 AND page > first_page GROUP BY doc_id
)"""
_FILES = """f AS (
  SELECT page_id, page_id % 3 = 0 AS broken, coalesce(html, '') AS html, ['csv', 'json', 'txt', 'pdf', 'exe', 'jsonl', 'html'][page_id % 7 + 1] AS ending FROM pages WHERE page_id IS NOT NULL
), c AS (
  SELECT *, CASE ending WHEN 'csv' THEN CASE WHEN broken THEN 'page,"' || page_id ELSE 'page,' || page_id || chr(10) || chr(10) || 'len,"' || length(html) || ',x"' || chr(10) END
    WHEN 'json' THEN CASE WHEN broken THEN '{"id": ' || page_id ELSE '{"id": ' || page_id || ', "sub": {"n": [' || page_id || ']}}' END
    WHEN 'pdf' THEN CASE WHEN broken THEN page_id :: VARCHAR ELSE '%PDF-' || page_id END WHEN 'exe' THEN 'MZ'
    WHEN 'jsonl' THEN CASE WHEN broken THEN '{"a": 1}' || chr(10) || '[2]' || chr(10) ELSE '{"a": 1}' || chr(10) || chr(10) || '{"b": null}' || chr(10) END
    ELSE CASE WHEN broken AND ending = 'html' THEN '' ELSE html END END AS content FROM f
), s AS (
  SELECT *, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS lines FROM c
), t AS (
  SELECT *, CASE WHEN strlen(content) > 10485760 THEN 'too_large' WHEN content = '' THEN 'empty' WHEN ending = 'exe' THEN 'unknown_kind'
    WHEN ending = 'csv' AND (length(content) - length(replace(content, '"', ''))) % 2 = 1 THEN 'bad_csv'
    WHEN ending IN ('json', 'jsonl') AND NOT list_bool_and(list_transform(lines, lambda x: json_valid(x) AND coalesce(json_type(CASE WHEN json_valid(x) THEN x END) = 'OBJECT', false))) THEN 'bad_json'
    WHEN ending = 'pdf' AND NOT starts_with(content, '%PDF') THEN 'bad_signature' END AS reason FROM s
)"""
_OPEN = """o AS (
  SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN '{}' ELSE '{"_page":' || o_orderkey % 4 || ',"number":"N-' || o_orderkey || '","total":'
      || CASE WHEN o_orderkey % 4 = 3 THEN 'null' ELSE (round(o_totalprice * 100) :: BIGINT) :: VARCHAR END || ',"vendor":{"id":' || o_custkey || ',"tags":["x",' || o_orderkey % 3 || ']}}' END AS l,
    '{"extra":{"k":' || o_orderkey % 9 || '},"total":' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ',"vendor":null' ELSE '' END || '}' AS r FROM orders
), k AS (
  SELECT *, unnest(list_distinct(list_concat(json_keys(l), json_keys(r)))) AS key FROM o
)"""
_RESOLVED = TALLY[len(VOTES) :].replace("FROM votes", "FROM every")
ORACLES = {
    "correction_submit": f"""WITH {DOCUMENTS}, d AS (
        SELECT doc_id, o_orderdate AS moment, amount_text, 'INV-' || strftime(o_orderdate, '%Y') || '-' || doc_id AS number, text, CASE WHEN doc_id % 7 <> 0 THEN doc_id % {VENDORS} END AS vendor FROM docs JOIN orders ON doc_id = o_orderkey
      ), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM docs WHERE doc_id % 5 = 0
      ), w AS (SELECT doc_id, line, unnest(string_split(content, ' ')) AS word, generate_subscripts(string_split(content, ' '), 1) - 1 AS n FROM lines
      ), t AS (SELECT doc_id, line * 20 + n AS tok, word, n * 90 + 20 AS x0, n * 90 + 20 + 8 * length(word) AS x1, line * 30 + 10 + (doc_id + n) % 3 AS y0, line * 30 + 22 + (doc_id + n) % 3 AS y1 FROM w
      ), s AS (SELECT doc_id, max(x1) AS width, max(y1) AS height FROM t GROUP BY doc_id
      ), v AS (
        SELECT doc_id, moment, vendor, field, CASE field WHEN 'invoice_number' THEN number WHEN 'total_amount' THEN amount_text ELSE 'EUR' END AS value,
          CASE field WHEN 'invoice_number' THEN CASE WHEN doc_id % 2 = 0 THEN number ELSE 'unread' END WHEN 'total_amount' THEN '0' END AS before
        FROM d, (VALUES ('invoice_number'), ('total_amount'), ('currency')) f(field) WHERE doc_id % 5 = 0
      ), a AS (
        SELECT v.doc_id, field, arg_min((x0 / width, y0 / height, x1 / width, y1 / height), tok) AS b FROM v JOIN t USING (doc_id) JOIN s USING (doc_id)
        WHERE word <> '' AND (contains(lower(value), lower(word)) OR contains(lower(word), lower(value))) AND NOT (field = 'currency' AND doc_id % 3 = 0) GROUP BY ALL
      ), e AS (SELECT vendor, field, value, min(moment) AS seen, count(*) AS n FROM v WHERE vendor IS NOT NULL GROUP BY ALL
      ), last AS (SELECT *, sum(n) OVER (PARTITION BY vendor, field) AS total FROM e QUALIFY row_number() OVER (PARTITION BY vendor, field ORDER BY seen DESC, value DESC) <= 5)
      SELECT 'document' AS part, doc_id AS id, '' AS field, CASE WHEN doc_id % 5 = 0 THEN 'CORRECTED|currency=EUR;invoice_number=' || number || ';total_amount=' || amount_text
        ELSE 'EXTRACTED|invoice_number=' || CASE WHEN doc_id % 2 = 0 THEN number ELSE 'unread' END || ';note=x;total_amount=0' END AS value FROM d
      UNION ALL SELECT 'correction', v.doc_id, v.field, coalesce(before, '-') || '|' || value || '|' || CASE WHEN v.field = 'currency' AND v.doc_id % 3 = 0 THEN '0.1000,0.2000,0.3000,0.4000|2'
        WHEN b IS NULL THEN '-|-' ELSE printf('%.4f,%.4f,%.4f,%.4f', b[1], b[2], b[3], b[4]) || '|1' END FROM v LEFT JOIN a ON a.doc_id = v.doc_id AND a.field = v.field WHERE before IS NULL OR before <> value
      UNION ALL SELECT 'template', vendor, field, string_agg(value, ';' ORDER BY seen, value) || '|' || any_value(total) FROM last GROUP BY vendor, field""",
    "routed_files": f"""WITH {_FILES} SELECT 'in/' || page_id || '.' || ending AS path, reason,
        CASE WHEN reason IS NOT NULL THEN 'failed' WHEN ending IN ('txt', 'html') THEN 'text' WHEN ending = 'pdf' THEN 'binary' WHEN ending = 'jsonl' THEN 'json' ELSE ending END AS route,
        CASE WHEN reason IS NULL AND ending = 'csv' THEN len(regexp_extract_all(content, '"[^"]*"|[^,\\n"]+')) ELSE 0 END :: INT AS cells,
        CASE WHEN reason IS NULL AND ending IN ('json', 'jsonl') THEN len(lines) ELSE 0 END :: INT AS records,
        CASE WHEN reason IS NULL AND ending IN ('txt', 'html') THEN length(content) ELSE 0 END :: INT AS chars FROM t""",
    "table_upsert": """WITH n AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
      SELECT coalesce(c_custkey, o_custkey) AS key, c_mktsegment AS segment, coalesce(round(o_totalprice, 2), round(c_acctbal, 2)) AS balance, o_orderdate, o_orderkey, o_orderstatus AS last_status
      FROM customer FULL JOIN n ON c_custkey = o_custkey""",
    "open_records": f"""WITH {_OPEN} SELECT doc_id, key,
        CAST(CASE WHEN list_contains(json_keys(r), key) THEN json_extract(r, '$.' || key) ELSE json_extract(l, '$.' || key) END AS VARCHAR) AS right_wins,
        CAST(CASE WHEN list_contains(json_keys(l), key) THEN json_extract(l, '$.' || key) ELSE json_extract(r, '$.' || key) END AS VARCHAR) AS left_wins,
        json_extract(l, '$.vendor.tags[1]') :: INT AS tag, doc_id AS seen_at, json_extract(l, '$.vendor.id') :: BIGINT AS vendor_id,
        array_to_string(list_sort(list_distinct(list_concat(json_keys(r), list_filter(json_keys(l), lambda x: x NOT IN ('total', 'vendor'))))), ',') AS carried FROM k""",
    "multipage_records": f"""WITH {_PAGES} SELECT doc_id, page_count, page_count > 1 AND NOT single AS multiple_invoices, f[1] AS invoice_number, f[2] AS total_amount, coalesce(counted.n, 0) AS n_items,
        coalesce(items, '') AS items, coalesce(others, '') AS others,
        counted.n > {MOST_ITEMS} OR coalesce(rest.n, 0) > {MOST_ITEMS} AS overflowed FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "multipage_overflow": f"""WITH {_PAGES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, item_no, l_quantity, amount) AS place, page, item_no, amount
      FROM items JOIN counted USING (doc_id) WHERE n > {MOST_ITEMS}""",
    "template_refresh": f"""WITH {VOTES}, {CORRECTIONS}, named AS (
        SELECT vendor_id, CASE field_name {_NAMED} END AS field, corrected_value, created_at, id FROM corrections
      ), distinct_values AS (
        SELECT vendor_id, field, corrected_value, max((created_at, id)) AS seen FROM named WHERE field IS NOT NULL GROUP BY ALL
      ), newest AS (
        SELECT * FROM distinct_values QUALIFY row_number() OVER (PARTITION BY vendor_id, field ORDER BY seen DESC) <= 5
      ), enough AS (
        SELECT vendor_id, field FROM named WHERE field IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}
      ), template AS (
        SELECT vendor_id, field, arg_min(corrected_value, seen) AS value FROM newest JOIN enough USING (vendor_id, field) GROUP BY ALL
      ), every AS (
        SELECT doc_id, voter, voter_ord, confidence, field, value FROM votes
        UNION ALL SELECT doc_id, 'ocr_template', {templated.TEMPLATE_ORDER}, 85.0, field, value
          FROM (SELECT DISTINCT doc_id FROM votes) JOIN template ON vendor_id = doc_id % {VENDORS}
      ){_RESOLVED}
      SELECT doc_id, field, value, confidence, agreement, list_contains(voters, 'ocr_template') AS template_applied FROM resolved""",
}
