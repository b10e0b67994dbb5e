"""Fields found by what stands around them: labels in plain text, dates within reach of
a label, lines that name what is due, and totals by their region of the page.

Inputs are the lines and tokens of ``layout``; a page is one window partition. All
candidates are (doc_id, field, value, score, ord), for ``fusion.fused`` to choose from.
Blank lines, nulls and pages without tokens give no candidates; ties go to the first line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money
from fieldloom.functions.text import first_case, first_of, id_normalise
from fieldloom.operators.layout import LABELS, PAGE, VALUE, engine_weight

# Labels of dates, words that disqualify a line, and scores and limits in pixels.
DATE_LABELS = {"invoice_date": r"(?i)\b(?:invoice\s*date|inv\s*date|date)\b", "due_date": r"(?i)\b(?:due\s*date|payment\s*due|pay\s*by)\b"}
DATE_WORDS = r"(?i)\b(?:date|payment\s*due|pay\s*by)\b"
DISQUALIFIED = {"invoice_date": "printed", "due_date": None}
TEXT_SCORE, BESIDE_BONUS, AHEAD = 0.45, 0.1, 4
LABEL_SCORE, LABEL_REACH = 0.4, 80
REACH_X, REACH_Y, LEAST_CONF = 420, 24, 0.6
BOTTOM_SHARE, RIGHT_SHARE = 0.4, 0.6
TOTAL_BONUS = {"label": 0.4, "decimals": 0.3, "currency": 0.2, "right": 0.2}


def _exploded(rows: DataFrame, candidates: list[Column], order: str) -> DataFrame:
    found = F.explode(F.array_compact(F.array(*candidates)))
    return rows.select("doc_id", F.col(order).alias("ord"), found.alias("c")).where("c.value is not null").select(
        "doc_id", "c.field", "c.value", F.round("c.score", 4).alias("score"), "ord"
    )


def _candidate(field: str, value: Column, score: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"), score.cast("double").alias("score"))


def _disqualified(field: str, line: Column) -> Column:
    word = DISQUALIFIED[field]
    return F.lower(line).contains(word) if word else F.lit(False)


def labelled_text(documents: DataFrame, weight: float = 1.0) -> DataFrame:
    """Candidates of texts (doc_id, text) alone: a value within 80 characters after a field's first label."""
    found = []
    for field, phrases in LABELS.items():
        label = r"(?is)\b(?:" + "|".join(p.replace(" ", r"\s*") for p in phrases) + r")\b(.{0," + str(LABEL_REACH) + "})"
        found.append(_candidate(field, first_of(first_of(F.col("text"), label), VALUE[field], 0), F.lit(LABEL_SCORE * weight)))
    return _exploded(documents.withColumn("_at", F.lit(0)), found, "_at")


def dates_in_text(documents: DataFrame, weight: float = 1.0) -> DataFrame:
    """Dates of texts (doc_id, text) on a label's line after it, else on the nearest of the
    next four lines that are not blank, name no other date and are not disqualified."""
    trimmed = F.filter(F.transform(F.split("text", r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    lines = documents.select("doc_id", trimmed.alias("lines")).select("doc_id", "lines", F.posexplode("lines").alias("line_no", "text"))
    ahead = F.slice("lines", F.col("line_no") + 2, AHEAD)

    def candidate(field: str, label: str) -> Column:
        allowed = lambda x: ~_disqualified(field, x)
        beside = dates.in_line(first_of(F.col("text"), label + r"(.*)$"))
        fits = F.filter(ahead, lambda x: ~x.rlike(DATE_WORDS) & allowed(x))
        below = F.try_element_at(F.filter(F.transform(fits, dates.in_line), lambda d: d.isNotNull()), F.lit(1))
        score = F.lit(TEXT_SCORE * weight) + F.when(beside.isNotNull(), BESIDE_BONUS * weight).otherwise(0.0)
        return F.when(F.col("text").rlike(label) & allowed(F.col("text")), _candidate(field, F.coalesce(beside, below), score))

    found = [candidate(field, label) for field, label in DATE_LABELS.items()]
    return _exploded(lines, found, "line_no")


def lines_with_tokens(lined: DataFrame) -> DataFrame:
    """Lines of numbered tokens with their sides, text, mean confidence and the page's size."""
    # one deal by document serves lines and pages; lines are not built before it, where a task reads many documents
    page = Window.partitionBy(*PAGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    word = F.struct("x0", "tok_no", "x1", "text", "conf")
    sure = F.when(F.col("conf") > 1, F.col("conf") / 100).otherwise(F.coalesce("conf", F.lit(0.4)))
    rows = lined.repartition("doc_id").withColumn("conf", sure).groupBy(*PAGE, "line_no").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.avg("conf").alias("conf"), F.max("x1").alias("right")
    )
    return rows.withColumns(
        {
            "text": F.array_join(F.transform("words", lambda w: w["text"]), " "),
            "width": F.max("right").over(page),
            "height": F.max("bottom").over(page),
            "weight": engine_weight(F.col("source")),
        }
    )


def dates_by_reach(lines: DataFrame) -> DataFrame:
    """Dates of ``lines_with_tokens`` that start within 420 pixels right of a label, else on the
    following line if at most 24 pixels lie between; words read with less than 0.6 do not count."""
    following = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = lines.withColumns({"next_text": F.lead("text").over(following), "gap": F.lead("top").over(following) - F.col("bottom")})

    def candidate(field: str, label: str) -> Column:
        # the label ends at the first word that reads like its last one
        last = F.lower(F.regexp_extract(F.regexp_extract("text", label, 0), r"(\w+)$", 1))
        ends = F.filter("words", lambda w: F.lower(F.regexp_replace(w["text"], r"\W", "")) == last)
        edge = F.try_element_at(ends, F.lit(1))["x1"]
        near = F.filter("words", lambda w: w["x0"].between(edge, edge + REACH_X) & (w["conf"] >= LEAST_CONF))
        beside = dates.in_line(F.array_join(F.transform(near, lambda w: w["text"]), " "))
        below = F.when((F.col("gap") <= REACH_Y) & ~F.col("next_text").rlike(DATE_WORDS), dates.in_line(F.col("next_text")))
        score = F.col("conf") * F.col("weight")
        return F.when(F.col("text").rlike(label) & ~_disqualified(field, F.col("text")), _candidate(field, F.coalesce(beside, below), score))

    found = [candidate(field, label) for field, label in DATE_LABELS.items()]
    return _exploded(rows, found, "line_no")


def due_lines(lines: DataFrame) -> DataFrame:
    """Date, number and order of the first line of a page that names what is due and holds
    any of them: its own date or a neighbour's, the number after the last bar or of five
    digits, and the order before the word."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    sides = {"before": F.lag("text").over(order), "after": F.lead("text").over(order)}
    rows = lines.withColumns(sides).where(F.col("text").rlike(r"(?i)d\s*u\s*e"))
    unprinted = lambda c: F.when(~F.lower(F.col(c)).contains("printed"), F.col(c))
    date = F.coalesce(dates.in_line(F.col("text")), dates.in_line(unprinted("before")), dates.in_line(unprinted("after")))
    five = r"\b(\d{5,})\b"
    number = F.coalesce(first_of(F.col("text"), r"\|(?!.*\|).*?\b([A-Za-z0-9]{5,})\b"), first_of(F.col("text"), five))
    head = F.regexp_replace("text", r"(?i)(.)due.*$", "$1")
    po = F.coalesce(*[first_of(head, p) for p in (r"\b([A-Za-z0-9]{3,}-[A-Za-z0-9]{1,})\b", r"\b([A-Za-z]\d{5,})\b", five)])
    found = rows.select(*PAGE, "line_no", "conf", "weight", date.alias("invoice_date"), id_normalise(number).alias("invoice_number"), id_normalise(po).alias("po_number"))
    some = found.where("coalesce(invoice_date, invoice_number, po_number) is not null")
    first = some.withColumn("place", F.row_number().over(order)).where("place = 1")
    score = F.col("conf") * F.col("weight")
    return _exploded(first, [_candidate(f, F.col(f), score) for f in ("invoice_date", "invoice_number", "po_number")], "line_no")


def totals_by_region(lines: DataFrame) -> DataFrame:
    """The best amount in the right 40 % of the lowest 40 % of each page, on its own line or
    below one that says total or amount; only amounts with decimals count."""
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    centre = lambda w: (w["x0"] + w["x1"]) / 2
    inside = F.filter("words", lambda w: (centre(w) >= F.col("width") * RIGHT_SHARE) & w["text"].rlike("[0-9]"))
    rows = lines.withColumn("amounts", F.array_join(F.transform(inside, lambda w: w["text"]), " "))
    rows = rows.withColumn("below", F.lead("amounts").over(order)).where((F.col("top") + F.col("bottom")) / 2 >= F.col("height") * (1 - BOTTOM_SHARE))
    named = F.lower("text").rlike("total|amount")
    written = F.when(F.col("amounts") != "", F.col("amounts")).when(named, F.col("below"))
    right = F.exists("words", lambda w: centre(w) >= F.col("width") * RIGHT_SHARE)
    each = rows.select(*PAGE, "line_no", "conf", "weight", "text", named.alias("named"), right.alias("at_right"), F.explode(F.regexp_extract_all(written, F.lit(r"([-+]?\d+(?:[.,]\d{2,3})+)"), F.lit(1))).alias("amount"))
    value = money.decimal_value(F.col("amount"))
    bonus = lambda test, name: F.when(test, TOTAL_BONUS[name]).otherwise(0.0)
    score = F.col("conf") * F.col("weight") + bonus(F.col("named"), "label") + TOTAL_BONUS["decimals"] + bonus(F.col("text").contains("$"), "currency") + bonus(F.col("at_right"), "right")
    good = each.withColumns({"value": value, "score": score}).where(F.col("amount").rlike(r"[.,]\d{2}\b") & (F.col("value") > 0))
    best = good.groupBy(*PAGE).agg(F.min(F.struct((-F.col("score")).alias("off"), "line_no", "value", "amount")).alias("b"))
    return best.select("doc_id", F.lit("total_amount").alias("field"), F.col("b.amount").alias("value"), F.round(-F.col("b.off"), 4).alias("score"), F.col("b.line_no").alias("ord"))


# Engines in the order in which their tokens are preferred.
PREFERRED_SOURCES = ("tesseract_v3", "paddle_v1", "paddle_v2")


def chosen_source(tokens: DataFrame) -> DataFrame:
    """Each page's tokens of the first preferred engine that read it; pages of other engines alone have none."""
    rank = first_case([(F.col("source") == s, F.lit(k)) for k, s in enumerate(PREFERRED_SOURCES)], F.lit(None).cast("int"))
    ranked = tokens.withColumn("_rank", rank).where("_rank is not null")
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy("doc_id", "page"))).where("_rank = _best").drop("_rank", "_best")
