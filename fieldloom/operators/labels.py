"""Labels of fields in lines of text: by rule, by meaning, or both; and tables of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import money
from fieldloom.operators.layout import LABELS

RULE_SCORE, MEANING = 0.95, 0.65
#: Vectors of a vocabulary that are broadcast at once.
WORDS = 10_000
# Words that rule a label out, and header words of item tables.
NEGATIVE = {
    "total_amount": ("subtotal", "sub total", "tax", "vat", "gst"),
    "invoice_date": ("due",),
    "due_date": ("invoice",),
    "invoice_number": ("po", "purchase order"),
    "po_number": ("invoice",),
}
ITEM_COLUMNS = {
    "description": ("description", "item", "product", "service"),
    "quantity": ("quantity", "qty", "amount"),
    "unit_price": ("unit price", "price", "rate"),
    "total": ("total", "amount", "line total"),
}
SKIPPED_ROWS = ("total", "subtotal", "tax", "grand")


def rule_labels(line: Column) -> Column:
    """Fields whose label a line holds and whose excluding words it does not."""
    low = F.lower(line)
    out = []
    for field, phrases in LABELS.items():
        pattern = r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s*") for p in phrases) + r")\b"
        vetoed = F.lit(False)
        for word in NEGATIVE[field]:
            vetoed = vetoed | low.contains(word)
        out.append(F.when(line.rlike(pattern) & ~vetoed, field))
    return F.array_compact(F.array(*out))


def nearest(lines: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(line_id, field, score): of lines (line_id, vector) the nearest synonym (field,
    vector), the smallest field on ties. The vocabulary is broadcast in blocks of
    at most about ``WORDS`` vectors; each line keeps its best of every block."""
    n = max(1, -(-synonyms.count() // WORDS))
    block = F.pmod(F.xxhash64("field", "vector"), F.lit(n))
    best = None
    for k in range(n):
        words = F.broadcast(synonyms.where(block == k).select("field", F.col("vector").alias("word")))
        scored = lines.join(words).withColumn("score", F.round(money.cosine(F.col("vector"), F.col("word")), 6))
        own = scored.groupBy("line_id").agg(F.min(F.struct((-F.col("score")).alias("off"), "field")).alias("best"))
        best = own if best is None else best.unionAll(own)
    return best.groupBy("line_id").agg(F.min("best").alias("best")).select("line_id", "best.field", (-F.col("best.off")).alias("score"))


def by_meaning(lines: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Lines with the field of the nearest synonym, if it is near enough."""
    return nearest(lines, synonyms).where(F.col("score") >= MEANING)


def matched(rule: Column, meaning: Column, mode: str = "hybrid") -> Column:
    """The field by rule, by meaning, or by rule and else by meaning."""
    return {"rule": rule, "semantic": meaning, "hybrid": F.coalesce(rule, meaning)}[mode]


def table_items(cells: DataFrame) -> DataFrame:
    """Items of tables (doc_id, row, col, value) whose first row is a header: a row
    with a description and a quantity or total, unless its first cell names a sum."""
    low = F.lower("value")
    roles = []
    for role, words in ITEM_COLUMNS.items():
        named = F.lit(False)
        for word in words:
            named = named | low.contains(word)
        roles.append(F.when(named, role))
    skipped = F.lit(False)
    for word in SKIPPED_ROWS:
        skipped = skipped | low.contains(word)
    # rows become one row each, and what the header names is seen over the table: cells dealt by document are not dealt again
    named_at = [F.when(F.col("row") == 0, F.min(F.when(F.col("role_" + r), F.col("col")))).alias("at_" + r) for r in ITEM_COLUMNS]
    rows = (
        cells.select("doc_id", "row", "col", F.trim("value").alias("value"), ((F.col("col") == 0) & skipped).alias("sum"), *[F.coalesce(role.isNotNull(), F.lit(False)).alias("role_" + r) for r, role in zip(ITEM_COLUMNS, roles)])
        .groupBy("doc_id", "row")
        .agg(F.collect_list(F.struct("col", "value")).alias("cells"), F.max("sum").alias("sum"), *named_at)
    )
    table = Window.partitionBy("doc_id")
    placed = rows.withColumns({"at_" + r: F.min("at_" + r).over(table) for r in ITEM_COLUMNS}).where("row > 0 and not coalesce(sum, false)")
    of = lambda role: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == F.col("at_" + role)), lambda c: c["value"]))
    found = placed.select("doc_id", "row", of("description").alias("description"), *[money.table_number(of(r)).alias(r) for r in ("quantity", "unit_price", "total")])
    return found.where("coalesce(description, '') <> '' AND (coalesce(quantity, 0) <> 0 OR coalesce(total, 0) <> 0)")
