"""Fields by pixel columns: the words beside or below a label, within the column that its
neighbours on the line leave it.

A label is a run of words, or single words where no run fits. Its column reaches to the
midpoints between its centre and those of the next labels of its line, else 20 pixels to
the left and 160 to the right. A line's words stand in one row beside those of the line
below, and each of its at most five labels looks through these two, so a page of many words is
never paired word by word and nothing is shuffled after pages. Words to the right of the label
come first, those of the line below after them. :func:`within` joins points and ranges that
do not lie together.

Cases: words without letters or digits are no part of a label; a null confidence does not
count, and words without any count 0.4; blank or null words read as nothing; a page
without labels gives no candidate; labels of one centre (within 4 pixels) do not bound one
another; of several lines with a label the first with a value counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money
from fieldloom.functions.text import id_normalise, let, token_key
from fieldloom.operators import layout
from fieldloom.operators.layout import PAGE, engine_weight

#: Pixels of a bucket of the interval join.
BUCKET = 256


@dataclass(frozen=True)
class Label:
    patterns: tuple[str, ...]
    phrases: tuple[str, ...]
    words: tuple[str, ...]
    kind: str
    #: One of these lower-case parts stands in every text that matches a pattern.
    parts: tuple[str, ...]
    barred: str | None = None


# What names each field, in the order in which it is looked for, and pixels.
SPECS = {
    "invoice_number": Label(
        (r"(?i)\binvoice\s*(number|no|#|id)\b", r"(?i)\binv\s*(number|no|#)\b"),
        ("invoice number", "invoice no", "invoice id", "inv number", "inv no"),
        ("invoice", "inv", "number", "no", "#", "id"),
        "id",
        ("inv",),
    ),
    "po_number": Label(
        (r"(?i)\b(purchase\s*order|po\s*(number|#)|p\.?o\.?)\b", r"(?i)\byour\s*purchase\s*order\b"),
        ("your purchase order", "purchase order", "po", "p o"),
        ("purchase", "order", "po", "your"),
        "id",
        ("purchase", "po", "p.o"),
    ),
    "invoice_date": Label(
        (r"(?i)\binvoice\s*date\b", r"(?i)\binv\s*date\b", r"(?i)\bdate\b"), ("invoice date", "inv date"), ("invoice", "inv", "date"), "date", ("date",), "printed"
    ),
    "due_date": Label(
        (r"(?i)\bdue\s*date\b", r"(?i)\bpayment\s*due\b", r"(?i)\bpay\s*by\b"), ("due date", "payment due", "pay by"), ("due", "payment", "pay"), "date", ("due", "pay")
    ),
    "total_amount": Label(
        (r"(?i)\b(total\s*amount|total\s*due|grand\s*total|amount\s*due|balance\s*due|total)\b",),
        ("total amount", "total due", "grand total", "amount due", "balance due", "total"),
        ("total", "amount", "balance", "grand", "due"),
        "amount",
        ("total", "due"),
    ),
}
LEFT, RIGHT, SAME = 20, 160, 4
BESIDE, BESIDE_START, BELOW = 6, 4, 8
NO_CONFIDENCE = 0.4
NORMALISED = {"id": id_normalise, "date": dates.fused, "amount": money.fused_amount}


def within(points: DataFrame, ranges: DataFrame, on: list[str], at: str, low: str, high: str, width: int = BUCKET) -> DataFrame:
    """Interval join: the points of each range of the same ``on``, low <= at <= high.

    A range is repeated for each bucket that it touches, a point lies in one, so a pair meets
    once and only points of the same buckets are compared."""
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = points.withColumn("_bucket", bucket(at)).join(spread, [*on, "_bucket"])
    return met.where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")


def _word(column: Callable[[str], Column]) -> dict[str, Column]:
    """What a word is: in the order in which words of a line are sorted."""
    conf = column("conf")
    return {
        "centre": (column("x0") + column("x1")) / 2, "tok_no": column("tok_no"), "text": F.coalesce(column("text"), F.lit("")), "x0": column("x0"), "x1": column("x1"),
        "conf": F.when(conf > 1, conf / 100).otherwise(conf),
    }


def words_of_lines(lined: DataFrame) -> DataFrame:
    """Tokens of ``layout.grouped_lines`` with the centre and confidence of each."""
    return lined.select(*PAGE, "line_no", *[c.alias(n) for n, c in _word(F.col).items()])


def lines_of_pages(tokens: DataFrame) -> DataFrame:
    """One row a line of tokens: its words in order of their centres, and those of the line below. Lines are told
    apart inside the page's row, so its tokens are gathered once."""
    word = lambda t: F.struct(*[c.alias(n) for n, c in _word(lambda x: t[x]).items()])
    pages = layout.page_lines(tokens, word)
    pair = let(F.col("lines"), lambda lines: F.transform(lines, lambda words, k: F.struct(words.alias("words"), F.get(lines, k + 1).alias("below"))))
    return pages.select(*PAGE, F.posexplode(pair).alias("line_no", "l")).select(*PAGE, "line_no", "l.words", "l.below")


def lines_of_words(words: DataFrame) -> DataFrame:
    """The same of the words of ``layout.grouped_lines``."""
    page = Window.partitionBy(*PAGE).orderBy("line_no")
    lines = _lines(words).withColumn("next", F.lead(F.struct("line_no", "words")).over(page))
    return lines.select(*PAGE, "line_no", "words", F.when(F.col("next.line_no") == F.col("line_no") + 1, F.col("next.words")).alias("below"))


def _run(phrase: str) -> Column:
    """struct(at, n) of the first words of ``line_key`` that read like a phrase, null if there are none."""
    found = F.instr("line_key", f" {phrase} ")
    ahead = F.substring(F.col("line_key"), F.lit(1), found)
    at = F.length(ahead) - F.length(F.replace(ahead, F.lit(" "), F.lit("")))  # blanks up to the phrase
    return F.when(found > 0, F.struct(at.alias("at"), F.lit(len(phrase.split())).alias("n")))


def _label(field: str, spec: Label) -> Column:
    """struct(field, left, right, centre) of a field's label on a line, null without one."""
    single = F.filter("keyed", lambda w: w["key"].isin(*spec.words))
    words = let(F.coalesce(*map(_run, spec.phrases)), lambda r: F.when(r.isNotNull(), F.slice("keyed", r["at"], r["n"])).otherwise(single))
    label = lambda ws: F.when(
        F.size(ws) > 0,
        F.struct(
            F.lit(field).alias("field"),
            F.array_min(F.transform(ws, lambda w: w["x0"])).alias("left"),
            F.array_max(F.transform(ws, lambda w: w["x1"])).alias("right"),
            (F.aggregate(ws, F.lit(0.0), lambda a, w: a + w["centre"]) / F.size(ws)).alias("centre"),
        ),
    )
    # a plain search for each word comes first
    return F.when(_any([F.col("line_key").contains(f" {x} ") for x in {**dict.fromkeys(spec.words), **dict.fromkeys(spec.phrases)}]), let(words, label))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _named(field: str, spec: Label) -> Column:
    """The field, where ``text`` matches its patterns; a plain search comes before each pattern."""
    low = F.col("low")
    fits = _any([low.contains(x) for x in spec.parts]) & _any([F.col("text").rlike(x) for x in spec.patterns])
    return F.when(fits & ~low.contains(spec.barred) if spec.barred else fits, F.lit(field))


def _lines(words: DataFrame) -> DataFrame:
    """One row a line: its words in order of their centres."""
    word = F.struct("centre", "tok_no", "text", "x0", "x1", "conf")
    return words.groupBy(*PAGE, "line_no").agg(F.sort_array(F.collect_list(word)).alias("words"))


def _labelled(lines: DataFrame, *kept: str) -> DataFrame:
    """The column (left_bound to right_bound) of every label whose line matches its patterns, with the columns ``kept`` of its line."""
    texts = lines.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumn("low", F.lower("text"))
    # exploded, so that lines that name no field end here and no pattern is searched twice; what is no lambda
    # stands in a column of its own, since generators and lambdas are interpreted with all that they hold
    texts = texts.withColumn("named", F.array(*[_named(f, s) for f, s in SPECS.items()]))
    some = F.explode(F.filter(F.array(F.array_compact("named")), lambda n: F.size(n) > 0))
    fits = texts.select(*PAGE, "line_no", "words", *(c for c in kept if c != "words"), some.alias("named"))
    keys = F.transform("words", lambda w: F.struct(*[w[c].alias(c) for c in ("centre", "x0", "x1")], token_key(w["text"]).alias("key")))
    keyed = fits.withColumn("keyed", keys).withColumn("keyed", F.filter("keyed", lambda w: w["key"] != ""))
    keyed = keyed.withColumn("line_key", F.concat(F.lit(" "), F.array_join(F.col("keyed.key"), " "), F.lit(" ")))
    each = keyed.select(*PAGE, "line_no", *kept, "named", F.array(*[_label(f, s) for f, s in SPECS.items()]).alias("labels"))
    own = F.explode(F.filter("labels", lambda x: F.array_contains(F.col("named"), x["field"])))
    each = each.select(*PAGE, "line_no", *kept, own.alias("own"), F.col("labels.centre").alias("centres")).select(*PAGE, "line_no", *kept, "own.*", "centres")
    before = F.array_max(F.filter("centres", lambda c: c < F.col("centre") - SAME))
    after = F.array_min(F.filter("centres", lambda c: c > F.col("centre") + SAME))
    return each.select(
        *PAGE,
        "line_no",
        *kept,
        "field",
        F.col("right").alias("label_right"),
        F.coalesce((before + F.col("centre")) / 2, F.col("left") - LEFT).alias("left_bound"),
        F.coalesce((F.col("centre") + after) / 2, F.col("right") + RIGHT).alias("right_bound"),
    )


def label_columns(words: DataFrame) -> DataFrame:
    """The column (left_bound to right_bound) of every label whose line matches its patterns."""
    return _labelled(_lines(words))


def readings(lines: DataFrame) -> DataFrame:
    """The words beside each label, or below it where none stand beside: (page, line_no, field, raw, conf)."""
    labels = _labelled(lines, "words", "below")
    between = lambda w, reach: w["centre"].between(F.col("left_bound") - reach, F.col("right_bound") + reach)
    beside = F.filter("words", lambda w: between(w, BESIDE) & (w["x0"] >= F.col("label_right") - BESIDE_START))
    under = F.filter("below", lambda w: between(w, BELOW))
    # exploded, as a filter would look through the words twice
    near = F.explode(F.filter(F.transform(F.array(beside), lambda ws: F.when(F.size(ws) > 0, ws).otherwise(under)), lambda ws: F.size(ws) > 0))
    met = labels.select(*PAGE, "line_no", "field", near.alias("met"))
    sure = F.array_compact(F.col("met.conf"))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure)).otherwise(F.lit(NO_CONFIDENCE))
    return met.select(*PAGE, "line_no", "field", F.array_join(F.col("met.text"), " ").alias("raw"), mean.alias("conf"))


def anchored(lines: DataFrame) -> DataFrame:
    """Candidates (doc_id, field, value, score, source, ord) of :func:`lines_of_pages`: of each
    page and field the first line whose words read as a value of its kind."""
    of_kind = lambda kind: F.col("field").isin(*[f for f, s in SPECS.items() if s.kind == kind])
    value = F.coalesce(*[F.when(of_kind(kind), rule(F.col("raw"))) for kind, rule in NORMALISED.items()])
    # exploded, so that the value is computed once and not again for a filter
    read = readings(lines).select(*PAGE, "line_no", "field", "conf", F.explode(F.array_compact(F.array(value))).alias("value"))
    score = F.round(F.col("conf") * engine_weight(F.col("source")), 4)
    first = read.groupBy(*PAGE, "field").agg(F.min_by(F.struct("value", score.alias("score"), "line_no"), "line_no").alias("r"))
    return first.select("doc_id", "field", "r.value", "r.score", "source", F.col("r.line_no").alias("ord"))


def anchored_by_columns(lined: DataFrame) -> DataFrame:
    """:func:`anchored` of ``layout.grouped_lines``."""
    return anchored(lines_of_words(words_of_lines(lined)))
