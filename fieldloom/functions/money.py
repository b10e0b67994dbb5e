"""Money rules: formats of written amounts, their values and plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import digit_repair, first_case

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Upper bounds of the magnitudes, below which an amount has their name.
MAGNITUDES = ((1, "fractional"), (100, "tens"), (1000, "hundreds"), (10_000, "thousands"), (100_000, "ten_thousands"), (1_000_000, "hundred_thousands"))
TOO_LARGE, TOO_SMALL = 1_000_000, 0.01


def number(text: Column) -> Column:
    """A strictly written number as double, null otherwise."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def decimal_format(text: Column) -> Column:
    """How a written amount uses commas and points."""
    clean = F.trim(F.regexp_replace(text, "[$€£¥]", ""))
    size = F.length(clean)
    after = lambda mark: F.locate(mark, F.reverse(clean)) - 1  # characters after the last mark
    comma, point = clean.contains(","), clean.contains(".")
    return first_case(
        [
            (comma & point & (after(",") < after(".")), F.when(after(",") == 2, "european_period_thousands").otherwise("ambiguous")),
            (
                comma & point,
                F.when(after(".") == 2, "us").when(after(".") == 3, "us_three_decimals").otherwise("ambiguous"),
            ),
            (comma, F.when(after(",") == 2, "european_comma").when(after(",") == 3, "us_no_decimals").otherwise("ambiguous")),
            (point, F.when(after(".") == 2, "us_period").when(after(".") == 3, "european_no_decimals").otherwise("ambiguous")),
        ],
        F.when(size.isNotNull(), "no_separator"),
    )


def decimal_value(text: Column) -> Column:
    """The amount that a text writes in any of the formats, null if none."""
    clean, kind = F.regexp_replace(text, r"[$€£¥\s]", ""), decimal_format(text)
    by_comma = F.replace(F.replace(clean, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    by_point = F.replace(clean, F.lit(","), F.lit(""))
    comma_last = clean.rlike(r",[^.]*$")
    written = first_case(
        [
            (kind.isin("european_comma", "european_period_thousands"), by_comma),
            (kind.isin("us", "us_period", "us_three_decimals"), by_point),
            (kind.isin("us_no_decimals", "european_no_decimals"), F.translate(clean, ",.", "")),
            (kind == "no_separator", clean),
        ],
        F.when(comma_last, by_comma).otherwise(by_point),
    )
    return number(written)


def total_check(amount: Column) -> Column:
    """struct(valid, amount, warning) of a numeric total."""
    warning = first_case(
        [
            (amount.isNull(), F.lit("unreadable")),
            (amount < 0, F.lit("negative")),
            (amount == 0, F.lit("zero")),
            (amount < TOO_SMALL, F.lit("too_small")),
            (amount > TOO_LARGE, F.lit("too_large")),
        ],
        F.lit(None).cast("string"),
    )
    valid = F.coalesce(~warning.isin("unreadable", "too_small", "too_large"), F.lit(True))
    return F.struct(valid.alias("valid"), F.when(valid, amount).alias("amount"), warning.alias("warning"))


def magnitude(amount: Column) -> Column:
    size = F.abs(amount)
    return first_case(
        [(amount == 0, F.lit("zero")), *((size < limit, F.lit(name)) for limit, name in MAGNITUDES)], F.lit("millions_plus")
    )


def magnitude_level(name: Column) -> Column:
    """The place of a magnitude in the order tens ... millions_plus, null outside it."""
    order = F.array(*[F.lit(n) for _, n in MAGNITUDES[1:]], F.lit("millions_plus"))
    at = F.array_position(order, name)
    return F.when(at > 0, at)


def plausibility(amount: Column) -> Column:
    """struct(ok, code) of an amount's size."""
    whole = amount % 1 == 0
    code = first_case(
        [
            (amount < 0, F.lit("credit")),
            (amount == 0, F.lit("no_charge")),
            ((amount > 0.01) & (amount < 10), F.lit("small")),
            ((amount > 10_000) & whole, F.lit("large_whole")),
            (amount > 100_000, F.lit("high")),
        ],
        F.lit(None).cast("string"),
    )
    return F.struct(F.coalesce(~code.isin("small", "large_whole", "high"), F.lit(True)).alias("ok"), code.alias("code"))


def percent_difference(amount: Column, other: Column) -> Column:
    return F.when(amount > 0, F.abs(amount - other) / amount * 100).otherwise(F.lit(0.0))


def round_suspicion(amount: Column, items_sum: Column) -> Column:
    """Why a round amount is suspicious, null if it is not."""
    is_round = F.pmod(amount, F.lit(50.0)) == 0
    return (
        F.when(is_round & items_sum.isNotNull() & (percent_difference(amount, items_sum) > 10), "differs_from_items")
        .when(is_round & (amount >= 1000) & (F.pmod(amount, F.lit(100.0)) == 0), "very_round")
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 for other lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def table_number(text: Column) -> Column:
    return number(F.regexp_extract(F.regexp_replace(text, r"[$€£,\s]", ""), r"[0-9.]+", 0))


def bands(confidence: Column, high: float, middle: float) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= middle, "medium").otherwise("low")


def symbols_dropped(value: Column) -> Column:
    """An amount's text without currency symbols, still text."""
    return F.trim(F.translate(value, "$€£¥", ""))


def fused_amount(value: Column) -> Column:
    """The number of a recognised amount, letters read for digits mended, with up to two decimals; null without digits."""
    mended = digit_repair(F.replace(value, F.lit(","), F.lit(".")))
    return F.nullif(F.regexp_extract(mended, r"[-+]?[0-9]+(?:\.[0-9]{1,2})?", 0), F.lit(""))


def cropped_amount(text: Column) -> Column:
    """The first amount with two decimals, written with a point; null if none. Marks before the last are thousands'."""
    raw = F.regexp_extract(text, r"[-+]?[0-9]{1,3}(?:[.,][0-9]{3})*[.,][0-9]{2}", 0)
    whole = F.regexp_replace(F.left(raw, F.length(raw) - 3), "[.,]", "")
    return F.when(raw != "", F.format_string("%.2f", F.concat(whole, F.lit("."), F.right(raw, F.lit(2))).cast("double")))
