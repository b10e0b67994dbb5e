"""Positioned tokens: lines, labels and what stands beside them, columns and line items.

Tokens are (doc_id, page, source, tok_no, text, conf, x0, y0, x1, y1). A group
(doc_id, page, source) is one page, so grouped Python gets a bounded number of
rows; everything that is not order-dependent stays in expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import let

# Label phrases of each field, words of item columns and of summary lines.
LABELS = {
    "invoice_number": ("invoice number", "invoice no", "invoice id", "inv number", "inv no"),
    "po_number": ("your purchase order", "purchase order", "po", "p o"),
    "invoice_date": ("invoice date", "inv date", "date"),
    "due_date": ("due date", "payment due", "pay by"),
    "total_amount": ("total amount", "total due", "grand total", "amount due", "balance due", "total"),
}
HEADER_WORDS = {
    "qty": ("qty", "quantity", "qnty", "q'ty", "quant"),
    "description": ("description", "desc", "item", "product", "part", "name", "details"),
    "unit_price": ("unit", "price", "rate", "cost", "unitprice"),
    "amount": ("amount", "amt", "total", "ext", "extended", "line"),
}
SUMMARY = ("subtotal", "total", "tax", "balance", "amount due")
VALUE = {
    "invoice_number": r"[A-Za-z0-9][A-Za-z0-9-]*[0-9][A-Za-z0-9-]*",
    "po_number": r"[A-Za-z0-9-]*[0-9][A-Za-z0-9-]{2,}",
    "invoice_date": r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}",
    "due_date": r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}",
    "total_amount": r"[$€£]?[0-9][0-9.,]*",
}
ENGINE_WEIGHTS = (("paddle", 1.0), ("tesseract", 0.9), ("trocr", 0.7))
LEAST_GAP, GAP_SHARE = 24, 0.04
CONTINUATION_GAP, MIN_ROWS = 12, 2
_AMOUNT = re.compile(r"^[$€£]?-?[0-9][0-9.,]*$")
_SUMMARY = re.compile("|".join(map(re.escape, SUMMARY)))


def engine_weight(source: Column) -> Column:
    out = F.when(source.startswith(ENGINE_WEIGHTS[0][0]), ENGINE_WEIGHTS[0][1])
    for name, weight in ENGINE_WEIGHTS[1:]:
        out = out.when(source.startswith(name), weight)
    return out.otherwise(F.lit(0.7))


PAGE = ["doc_id", "page", "source"]
TOKEN = ["y0", "x0", "tok_no", "text", "conf", "x1", "y1"]


def lines_of(tops: list[int], bottoms: list[int]) -> list[int]:
    """Line numbers of tokens in order of y and x: a token joins the first line
    whose centre is near, and moves that centre halfway to itself."""
    return _joined([(y0 + y1) / 2 for y0, y1 in zip(tops, bottoms)], [max(0.6 * (y1 - y0), 8) for y0, y1 in zip(tops, bottoms)])


def _joined(middles: list[float], reaches: list[float]) -> list[int]:
    """:func:`lines_of` by the middles of tokens and how far each reaches."""
    centres: list[float] = []
    out = []
    for y, reach in zip(middles, reaches):
        low, high = y - reach, y + reach
        for at, c in enumerate(centres):  # the difference decides; the sums only pass over most lines at once
            if low - 1 <= c <= high + 1 and abs(y - c) <= reach:
                centres[at] = (c + y) / 2
                break
        else:
            at = len(centres)
            centres.append(y)
        out.append(at)
    return out


def _listed(column: pa.Array) -> list:
    """Plain values of a column; by numpy, which is several times as fast, where none is null."""
    return column.to_pylist() if column.null_count or pa.types.is_string(column.type) else column.to_numpy().tolist()


def _line_numbers(tops: pa.Array, bottoms: pa.Array) -> pa.Array:
    """Line numbers of pages; numbers leave and enter Arrow as whole columns."""
    ends, out = [0], []
    for own in _pages_lines(tops, bottoms):
        out += own
        ends.append(len(out))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.int32()))


def _pages_lines(tops: pa.Array, bottoms: pa.Array) -> Iterator[list[int]]:
    """The line numbers of one page after the other."""
    y0, y1 = tops.flatten(), bottoms.flatten()
    lengths = tops.value_lengths().to_pylist()
    at = 0
    if y0.null_count or y1.null_count:
        y0, y1 = y0.to_pylist(), y1.to_pylist()
        for n in lengths:
            yield lines_of(y0[at : at + n], y1[at : at + n])
            at += n
        return
    y0, y1 = y0.to_numpy().astype(float), y1.to_numpy().astype(float)
    middles, reaches = ((y0 + y1) / 2).tolist(), np.maximum(0.6 * (y1 - y0), 8).tolist()
    for n in lengths:
        yield _joined(middles[at : at + n], reaches[at : at + n])
        at += n


def _line_places(tops: pa.Array, bottoms: pa.Array) -> pa.Array:
    """Of each page the places (from 1) of each line's tokens."""
    pages, lines, out = [0], [0], []
    for own in _pages_lines(tops, bottoms):
        found: list[list[int]] = [[] for _ in range(max(own, default=-1) + 1)]
        for place, line in enumerate(own, 1):
            found[line].append(place)
        for places in found:
            out += places
            lines.append(len(out))
        pages.append(len(lines) - 1)
    inner = pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(out, pa.int32()))
    return pa.ListArray.from_arrays(pa.array(pages, pa.int32()), inner)


def pages_of(tokens: DataFrame, *more: str) -> DataFrame:
    """One row a page, with its tokens as an array in order of y, x and number."""
    return tokens.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*TOKEN, *more))).alias("tokens"))


def grouped_lines(tokens: DataFrame) -> DataFrame:
    """tokens with line_no, by page; a page's tokens are few and meet in one row."""
    numbered = pages_of(tokens).withColumn("lines", F.arrow_udf(_line_numbers, "array<int>")(F.col("tokens.y0"), F.col("tokens.y1")))
    return numbered.select(*PAGE, F.explode(F.arrays_zip("tokens", "lines")).alias("t")).select(
        *PAGE, *[F.col(f"t.tokens.{c}").alias(c) for c in TOKEN], F.col("t.lines").alias("line_no")
    )


def page_lines(tokens: DataFrame, word: Callable[[Column], Column]) -> DataFrame:
    """A page's lines in one row: ``lines``, an array by line number of the sorted ``word`` of each token (a struct with the columns TOKEN)."""
    numbered = pages_of(tokens).withColumn("places", F.arrow_udf(_line_places, "array<array<int>>")(F.col("tokens.y0"), F.col("tokens.y1")))
    # words are named once: what stands inside a lambda is computed for each of its elements
    lines = let(F.transform("tokens", word), lambda words: F.transform("places", lambda line: F.sort_array(F.transform(line, lambda k: F.element_at(words, k)))))
    return numbered.select(*PAGE, lines.alias("lines"))


def line_texts(lined: DataFrame) -> DataFrame:
    """doc_id, page, source, line_no, text and mean confidence of every line."""
    word = F.struct("x0", "tok_no", "text")
    return lined.groupBy("doc_id", "page", "source", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["text"]), " ").alias("text"),
        F.avg(F.when(F.col("conf") > 1, F.col("conf") / 100).otherwise(F.coalesce("conf", F.lit(0.4)))).alias("conf"),
    )


def anchored(lines: DataFrame) -> DataFrame:
    """Candidates (doc_id, field, value, score, ord) beside or below a label."""
    following = Window.partitionBy("doc_id", "page", "source").orderBy("line_no")
    low = F.lower("text")
    rows = lines.withColumn("below", F.lead("text").over(following))
    parts = []
    for field, phrases in LABELS.items():
        label = r"(?i)\b(?:" + "|".join(p.replace(" ", r"\s*") for p in phrases) + r")\b"
        rest = F.regexp_extract("text", label + r"[^\w$€£]*(.*)$", 1)
        beside, under = (F.nullif(F.regexp_extract(c, VALUE[field], 0), F.lit("")) for c in (rest, F.col("below")))
        parts.append(F.when(low.rlike(label), F.struct(F.lit(field).alias("field"), F.coalesce(beside, under).alias("value"))))
    return (
        rows.select("doc_id", "source", "line_no", "conf", F.explode(F.array_compact(F.array(*parts))).alias("c"))
        .where("c.value is not null")
        .select("doc_id", "c.field", "c.value", F.round(F.col("conf") * engine_weight(F.col("source")), 4).alias("score"), "source", F.col("line_no").alias("ord"))
    )


def footer_totals(tokens: DataFrame) -> DataFrame:
    """Of each page's money tokens the one lowest and furthest to the right."""
    page = Window.partitionBy("doc_id", "page", "source")
    digits = F.regexp_replace("text", r"[^0-9.,]", "")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return (
        tokens.withColumns({"digits": digits, "width": F.max("x1").over(page), "height": F.max("y1").over(page)})
        .where(F.col("digits").rlike(r"[0-9]+[.,][0-9]{2}$"))
        .withColumn("score", F.round(0.7 * y / F.col("height") + 0.3 * x / F.col("width"), 6))
        .withColumn("place", F.row_number().over(page.orderBy(F.col("score").desc(), "tok_no")))
        .where("place = 1")
        .select("doc_id", "page", "source", F.col("digits").alias("value"), "score", F.round(F.col("conf") * 100, 2).alias("confidence"))
    )


def numeric_columns(tokens: DataFrame) -> DataFrame:
    """Clusters of the centres of numeric tokens: a wider gap than the greater of
    24 px and 4 % of the page's width begins a new one."""
    # numbers come first in the one order, so that it serves the width of the page, the gaps and the sums; texts are not dealt
    order = Window.partitionBy("doc_id", "page", "source").orderBy(F.col("numeric").desc(), "centre", "tok_no")
    gap = F.col("centre") - F.lag("centre").over(order)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numeric = F.coalesce(F.col("text").rlike(_AMOUNT.pattern), F.lit(False))
    return (
        tokens.select("doc_id", "page", "source", "tok_no", "x1", ((F.col("x0") + F.col("x1")) / 2).alias("centre"), numeric.alias("numeric"))
        .withColumns({"gap": gap, "width": F.max("x1").over(whole)})
        .where("numeric")
        .withColumn("new", (F.col("gap") > F.greatest(F.lit(LEAST_GAP), F.col("width") * GAP_SHARE)).cast("int"))
        .withColumn("cluster", F.sum(F.coalesce("new", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .groupBy("doc_id", "page", "source", "cluster")
        .agg(F.count(F.lit(1)).alias("tokens"), F.round(F.avg("centre"), 3).alias("centre"))
    )


@lru_cache(maxsize=4096)
def role_of(word: str) -> str | None:
    bare = re.sub(r"[^a-z0-9]", "", word.lower())
    for role, words in HEADER_WORDS.items():
        if bare.startswith(words):
            return role
    return None


def _value(amount: str) -> float | None:
    """The number of a text that ``_AMOUNT`` matches."""
    bare = amount.rstrip("\n").lstrip("$€£")
    if bare[-3:-2] == "," and bare[-2:].isdigit():
        bare = bare.replace(".", "").replace(",", ".")
    try:
        return float(bare.replace(",", ""))
    except ValueError:
        return None


def _clusters(centres: list[float], width: float) -> list[float]:
    """Centres of columns of numbers, by the same gap as ``numeric_columns``."""
    groups: list[list[float]] = []
    for x in sorted(centres):
        if groups and x - groups[-1][-1] <= max(LEAST_GAP, width * GAP_SHARE):
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def items_of_page(tokens: list[tuple]) -> list[dict]:
    """Line items of one page: columns under a header of two or more roles, rows below it,
    lines of text alone joining the row above. Without such a header the columns are the
    clusters of numbers: the first a quantity, the last the amount, the one before it the
    price; a header that names no amount gets the last cluster for it.

    Tokens are (line_no, x0, tok_no, place on the page, x1, y0, y1, conf, text)."""
    lines: list[list[tuple]] = []  # of (centre, y0 + y1, conf, text, whether it is an amount)
    last, width = None, 0
    for line_no, x0, _, _, x1, y0, y1, conf, text in sorted(tokens):
        if line_no != last:
            lines.append([])
            last = line_no
        lines[-1].append(((x0 + x1) / 2, y0 + y1, conf, text, _AMOUNT.match(text) is not None))
        width = x1 if x1 > width else width
    roles = [[(t[0], r) for t in line if not t[4] and (r := role_of(t[3]))] for line in lines[:8]]  # no amount begins like a role
    scores = [len({r for _, r in found}) for found in roles]
    head = scores.index(max(scores)) if scores and max(scores) >= 2 else -1
    clusters = _clusters([t[0] for line in lines for t in line if t[4]], width)
    if head >= 0:
        columns = roles[head]
    else:
        inner = [(clusters[-2], "unit_price")] if len(clusters) > 2 else []
        columns = [(clusters[0], "qty"), *inner, (clusters[-1], "amount")] if len(clusters) > 1 else []
    if clusters and "amount" not in {r for _, r in columns}:
        columns.append((clusters[-1], "amount"))
    columns.sort()
    if not columns:
        return []
    edges = [(a[0] + b[0]) / 2 for a, b in zip(columns, columns[1:])]
    rows: list[dict] = []
    for line in lines[head + 1 :]:
        if _SUMMARY.search(" ".join([t[3] for t in line]).lower()):
            continue
        y = sum([t[1] for t in line]) / (2 * len(line))
        row = {"qty": None, "unit_price": None, "amount": None, "y": y}
        words, sure = [], 0
        for centre, _, conf, text, numeric in line:
            sure += conf
            role = columns[bisect_left(edges, centre)][1] if numeric else "description"
            if role == "description":
                words.append(text)
            elif row[role] is None:
                row[role] = _value(text)
        row["confidence"] = round(sure / len(line), 3)
        row["description"] = " ".join(words)
        if row["qty"] is None and row["unit_price"] is None and row["amount"] is None:
            if rows and row["description"] and abs(y - rows[-1]["y"]) <= CONTINUATION_GAP:
                rows[-1]["description"] = f"{rows[-1]['description']} {row['description']}".strip()
            continue
        rows.append(row)
    valid = [r for r in rows if r["amount"] is not None]
    return valid if len(valid) >= MIN_ROWS else []


_ITEM = (("item_no", "int", pa.int32()), ("description", "string", pa.string()), *((n, "double", pa.float64()) for n in ("quantity", "unit_price", "amount", "confidence")))
_ITEMS = f"array<struct<{', '.join(f'{name}: {kind}' for name, kind, _ in _ITEM)}>>"


def _items(pages: pa.Array) -> pa.Array:
    """Items of pages of tokens. Fields leave and enter Arrow as whole columns, not token by token."""
    flat = pages.flatten()
    line, x0, tok, x1, y0, y1, conf, text = (_listed(flat.field(c)) for c in ("line_no", "x0", "tok_no", "x1", "y0", "y1", "conf", "text"))
    rows = list(zip(line, x0, tok, range(len(tok)), x1, y0, y1, conf, text))
    ends, out, at = [0], [[] for _ in _ITEM], 0
    for n in pages.value_lengths().to_pylist():
        for k, r in enumerate(items_of_page(rows[at : at + (n or 0)]), 1):
            for column, value in zip(out, (k, r["description"], r["qty"], r["unit_price"], r["amount"], r["confidence"])):
                column.append(value)
        at += n or 0
        ends.append(len(out[0]))
    items = pa.StructArray.from_arrays([pa.array(column, kind) for column, (_, _, kind) in zip(out, _ITEM)], [name for name, _, _ in _ITEM])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)


def line_items(lined: DataFrame) -> DataFrame:
    """doc_id, item_no, description, quantity, unit_price, amount, confidence."""
    return pages_of(lined, "line_no").select("doc_id", F.explode(F.arrow_udf(_items, _ITEMS)("tokens")).alias("i")).select("doc_id", "i.*")


def matching_tokens(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """For values (doc_id, field, value) the first token that equals, holds or lies in the value."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    # keys are made where values and tokens meet; values are held, so tokens are not sorted
    near = tokens.select("doc_id", "page", "tok_no", "text", "x0", "y0", "x1", "y1")
    joined = near.join(values.select("doc_id", "field", "value").hint("shuffle_hash"), "doc_id")
    met = joined.withColumns({"token_key": key(F.col("text")), "value_key": key(F.col("value"))}).where("token_key <> ''").where(
        (F.col("token_key") == F.col("value_key")) | F.col("token_key").contains(F.col("value_key")) | F.col("value_key").contains(F.col("token_key"))
    )
    best = F.struct((F.col("token_key") != F.col("value_key")).alias("inexact"), "page", "tok_no")
    return met.groupBy("doc_id", "field").agg(
        F.min_by("text", best).alias("token"), F.min_by(F.array("x0", "y0", "x1", "y1"), best).alias("box"), F.min_by("page", best).alias("page")
    )
