"""Image quality and page geometry from metrics tables, and producers' confidences.

Reading pixels is not this engine's work: it takes their metrics (size, resolution,
sharpness, contrast, brightness) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least metrics of a readable image, paper in inches, resolutions.
LEAST_WIDTH, LEAST_HEIGHT, LEAST_DPI, LEAST_SHARPNESS, LEAST_CONTRAST = 800, 600, 150, 100.0, 30.0
BRIGHTNESS = (50, 230)
PAPER = {"letter": (11.0, 8.5), "a4": (11.69, 8.27)}
TARGET_DPI, SMALL_FONT_DPI, DEAD_BAND = 300, 350, 0.05
FIELD_WEIGHTS = {"vendor_name": 1.5, "invoice_number": 1.8, "total_amount": 2.0, "invoice_date": 1.5, "currency": 0.5, "po_number": 0.5}


def quality_codes(width: Column, height: Column, dpi: Column, sharpness: Column, contrast: Column, brightness: Column) -> Column:
    """What is wrong with an image, as codes."""
    return F.array_compact(
        F.array(
            F.when((width < LEAST_WIDTH) | (height < LEAST_HEIGHT), "small"),
            F.when(dpi < LEAST_DPI, "low_dpi"),
            F.when(sharpness < LEAST_SHARPNESS, "blurred"),
            F.when(contrast < LEAST_CONTRAST, "low_contrast"),
            F.when(brightness < BRIGHTNESS[0], "dark").when(brightness > BRIGHTNESS[1], "bright"),
        )
    )


def geometry(width: Column, height: Column, known_dpi: Column, small_font: Column) -> Column:
    """struct(paper, dpi, scale): the nearest paper by its ratio, the resolution that
    it implies unless one is known, and the factor to the target, never below 1."""
    long, short = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    off = {p: F.abs(long / short - a / b) for p, (a, b) in PAPER.items()}
    letter = off["letter"] <= off["a4"]
    by_paper = {p: F.least(long / F.lit(a), short / F.lit(b)) for p, (a, b) in PAPER.items()}
    dpi = F.when(known_dpi > 0, known_dpi.cast("double")).when(letter, by_paper["letter"]).otherwise(by_paper["a4"])
    raw = F.greatest(F.when(small_font, SMALL_FONT_DPI).otherwise(TARGET_DPI) / dpi, F.lit(1.0))
    return F.struct(
        F.when(letter, "letter").otherwise("a4").alias("paper"),
        F.round(dpi, 2).alias("dpi"),
        F.round(F.when(raw - 1 < DEAD_BAND, F.lit(1.0)).otherwise(raw), 4).alias("scale"),
    )


def weighted_confidence(confidences: Column) -> Column:
    """Mean of a map of confidences by the fields' weights; 0 for an empty map."""
    pairs = [F.lit(x) for item in FIELD_WEIGHTS.items() for x in item]
    weight = lambda f: F.coalesce(F.try_element_at(F.create_map(*pairs), f), F.lit(1.0))
    entries = F.map_entries(confidences)
    total = lambda of: F.aggregate(entries, F.lit(0.0), lambda s, e: s + of(e))
    return F.when(F.size(entries) > 0, F.round(total(lambda e: weight(e["key"]) * e["value"]) / total(lambda e: weight(e["key"])), 2)).otherwise(F.lit(0.0))
