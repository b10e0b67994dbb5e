"""Pages laid out in columns or rows of labels, and what is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import columns, fusion
from fieldloom.plans import render
from fieldloom.plans.sql import DOCUMENTS
from fieldloom.session import table

# What stands where: form (all, 0 in columns, 1 in rows), line, x and text; a text in braces is a value.
_PLACES = (
    ("all", 0, 20, "Invoice"), ("all", 0, 100, "Date"), ("all", 0, 160, "printed"), ("all", 0, 240, "01/02/2001"),
    (0, 1, 20, "Invoice"), (0, 1, 90, "Number"), (0, 1, 300, "Your"), (0, 1, 350, "Purchase"), (0, 1, 430, "Order"),
    (0, 1, 600, "Invoice"), (0, 1, 670, "Date"), (0, 1, 800, "Due"), (0, 1, 840, "Date"),
    (0, 2, 30, "{number}"), (0, 2, 310, "{po}"), (0, 2, 600, "{date}"), (0, 2, 830, "{due}"),
    (0, 3, 400, "Grand"), (0, 3, 460, "Total"), (0, 4, 430, "{amount}"),
    (1, 1, 20, "Inv"), (1, 1, 60, "No"), (1, 1, 120, "{number}"), (1, 2, 20, "P"), (1, 2, 40, "O"), (1, 2, 120, "{po}"),
    (1, 3, 20, "Date"), (1, 3, 120, "{date}"), (1, 4, 20, "Pay"), (1, 4, 60, "by"), (1, 4, 120, "{due}"),
    (1, 5, 400, "Total"), (1, 5, 460, "Amount"), (1, 5, 560, "{amount}"),
)


#: Orders are dealt once, before they become forms, and all that follows keeps to that.
DOCUMENTS_OF_TASK = 50_000


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a form of every order: two of three with labels above their values, the others
    with labels before them."""
    docs = render.documents(spark, folder, DOCUMENTS_OF_TASK).select("doc_id", "amount_text", "date_text")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    k = F.col("doc_id").cast("string")
    values = {
        "{number}": F.concat(F.lit("INV-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), k),
        "{po}": F.concat(F.lit("PO-"), k),
        "{date}": F.col("date_text"),
        "{due}": F.date_format(F.date_add("o_orderdate", 30), "MM/dd/yyyy"),
        "{amount}": F.col("amount_text"),
    }
    place = lambda line, x, text: F.struct(F.lit(line).alias("line"), F.lit(x).alias("x"), values.get(text, F.lit(text)).alias("content"))
    form = lambda n: F.array(*[place(*rest) for f, *rest in _PLACES if f in (n, "all")])
    placed = docs.join(orders, "doc_id").select("doc_id", F.explode(F.when(k.cast("long") % 3 == 0, form(1)).otherwise(form(0))).alias("p")).select("doc_id", "p.*")
    words = placed.select("doc_id", "line", "x", F.posexplode(F.split("content", " ")).alias("n", "text"))
    x0, y0 = F.col("x") + F.col("n") * 50, F.col("line") * 30 + 10 + F.pmod(F.col("doc_id") + F.col("x"), F.lit(3)).cast("int")
    return words.select(
        "doc_id", F.lit(1).alias("page"), F.lit("tesseract_v3").alias("source"), (F.col("line") * 1000 + x0).alias("tok_no"), "text",
        (F.lit(0.6) + F.pmod(F.col("doc_id") + F.col("line"), F.lit(4)) / 10.0).alias("conf"), x0.alias("x0"), y0.alias("y0"),
        (x0 + F.length("text") * 8).alias("x1"), (y0 + 12).alias("y1"),
    )


def column_fields(spark: SparkSession, folder: str) -> DataFrame:
    """All five fields of the forms, by the columns of their labels."""
    found = columns.anchored(columns.lines_of_pages(forms(spark, folder)))
    return fusion.fused(found).select("doc_id", "field", "value", "score")


QUERIES = {f.__name__: f for f in (column_fields,)}


def _listed(rows) -> str:
    literal = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(literal, r))})" for r in rows)


_PHRASES = [(f, n, p) for f, s in columns.SPECS.items() for n, p in enumerate(s.phrases)]
_WORDS = [(f, w) for f, s in columns.SPECS.items() for w in s.words]
_PATTERNS = [(f, p) for f, s in columns.SPECS.items() for p in s.patterns]
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"

#: The rule over the same tokens, word by word: labels as joined neighbours, columns by lag and lead, values by range.
COLUMN_FIELDS = f"""WITH {DOCUMENTS}, places(form, line, x, content) AS (VALUES {_listed([(str(f), line, x, text) for f, line, x, text in _PLACES])}
), placed AS (
  SELECT doc_id, line, x, CASE content WHEN '{{number}}' THEN 'INV-' || strftime(o_orderdate, '%Y') || '-' || doc_id WHEN '{{po}}' THEN 'PO-' || doc_id
    WHEN '{{date}}' THEN date_text WHEN '{{due}}' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y') WHEN '{{amount}}' THEN amount_text ELSE content END AS content
  FROM docs JOIN orders ON doc_id = o_orderkey JOIN places ON form = 'all' OR form = CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END
), w AS (
  SELECT doc_id, line, x + n * 50 AS x0, x + n * 50 + 8 * len(word) AS x1, x + n * 50 + 4.0 * len(word) AS c, word,
    regexp_replace(lower(word), '[^a-z0-9#]+', '', 'g') AS key, 0.6 + ((doc_id + line) % 4) / 10.0 AS conf
  FROM (SELECT doc_id, line, x, unnest(string_split(content, ' ')) AS word, generate_subscripts(string_split(content, ' '), 1) - 1 AS n FROM placed)
), t AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY c) AS i FROM w WHERE key <> ''
), texts AS (
  SELECT doc_id, line, string_agg(word, ' ' ORDER BY c) AS text FROM w GROUP BY doc_id, line
), phrases(field, rank, phrase) AS (VALUES {_listed(_PHRASES)}
), singles(field, word) AS (VALUES {_listed(_WORDS)}
), patterns(field, pattern) AS (VALUES {_listed(_PATTERNS)}
), runs AS (
  SELECT a.doc_id, a.line, field, rank, a.i, list(b.c) AS cs, min(b.x0) AS x0, max(b.x1) AS x1, string_agg(b.key, ' ' ORDER BY b.i) AS run, phrase
  FROM t a, phrases, t b WHERE a.doc_id = b.doc_id AND a.line = b.line AND a.key = string_split(phrase, ' ')[1] AND b.i BETWEEN a.i AND a.i + len(string_split(phrase, ' ')) - 1
  GROUP BY ALL HAVING run = phrase
), labels AS (
  SELECT doc_id, line, field, list_avg(cs) AS c, x0, x1 FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, line, field ORDER BY rank, i) = 1
  UNION ALL
  SELECT doc_id, line, field, avg(c), min(x0), max(x1) FROM t JOIN singles ON key = singles.word
  WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = t.doc_id AND runs.line = t.line AND runs.field = singles.field) GROUP BY doc_id, line, field
), bounds AS (
  SELECT a.doc_id, a.line, a.field, a.x1 AS edge,
    coalesce((max(b.c) FILTER (b.c < a.c - 4) + a.c) / 2, a.x0 - 20) AS low, coalesce((min(b.c) FILTER (b.c > a.c + 4) + a.c) / 2, a.x1 + 160) AS high
  FROM labels a JOIN labels b ON a.doc_id = b.doc_id AND a.line = b.line GROUP BY a.doc_id, a.line, a.field, a.x0, a.x1, a.c
), named AS (
  SELECT DISTINCT b.* FROM bounds b JOIN texts USING (doc_id, line) JOIN patterns p ON p.field = b.field AND regexp_matches(text, pattern)
  WHERE b.field <> 'invoice_date' OR NOT contains(lower(text), 'printed')
), near AS (
  SELECT * FROM (
    SELECT n.doc_id, n.line, n.field, w.line - n.line AS way, string_agg(word, ' ' ORDER BY c) AS raw, avg(conf) AS conf
    FROM named n JOIN w ON w.doc_id = n.doc_id AND ((w.line = n.line AND x0 >= edge - 4 AND c BETWEEN low - 6 AND high + 6) OR (w.line = n.line + 1 AND c BETWEEN low - 8 AND high + 8))
    GROUP BY n.doc_id, n.line, n.field, w.line - n.line
  ) QUALIFY row_number() OVER (PARTITION BY doc_id, line, field ORDER BY way) = 1
), mended AS (
  SELECT *, translate(raw, 'OoIlSB', '001158') AS m, regexp_extract(lower(raw), '\\b{_MONTH}\\s+(\\d{{1,2}})[,\\s]+(\\d{{2,4}})\\b', ['mon', 'd', 'y']) AS mdy,
    regexp_extract(lower(raw), '\\b(\\d{{1,2}})\\s+{_MONTH}[,\\s]+(\\d{{2,4}})\\b', ['d', 'mon', 'y']) AS dmy FROM near
), valued AS (
  SELECT doc_id, line, field, round(conf * 0.9, 4) :: DOUBLE AS score, nullif(CASE
    WHEN field IN ('invoice_number', 'po_number') THEN CASE WHEN regexp_matches(regexp_replace(m, '[^A-Za-z0-9-]', '', 'g'), '[0-9]') THEN regexp_replace(m, '[^A-Za-z0-9-]', '', 'g') ELSE '' END
    WHEN field = 'total_amount' THEN regexp_extract(translate(m, ',', '.'), '[-+]?[0-9]+(\\.[0-9]{{1,2}})?')
    WHEN mdy.y <> '' THEN strftime(strptime(mdy.mon || ' ' || mdy.d || ' ' || mdy.y, '%b %d %Y'), '%m/%d/%Y')
    WHEN dmy.y <> '' THEN strftime(strptime(dmy.mon || ' ' || dmy.d || ' ' || dmy.y, '%b %d %Y'), '%m/%d/%Y')
    WHEN regexp_matches(m, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') THEN regexp_extract(m, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')
    ELSE regexp_extract(regexp_replace(m, '[^0-9]+', '/', 'g'), '\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}}') END, '') AS value
  FROM mended
)
SELECT doc_id, field, value, score FROM valued WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY line) = 1"""

ORACLES = {"column_fields": COLUMN_FIELDS}
