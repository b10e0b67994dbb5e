"""Recognised words as token structs, pages to read, and confidences of producers.

Cases: blank words are no tokens; a word without a box is none either; a page without a size
gives tokens without shares; a record without fields has confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages that are read at most, and what the visual parser's confidence is made of.
MOST_PAGES = 10
VISUAL_FIELDS, VISUAL_BONUS = 4, {"vendor_name": 5, "invoice_number": 5, "total_amount": 10}
SIDES = ("left", "top", "width", "height")


def token_structs(pages: DataFrame) -> DataFrame:
    """Tokens (doc_id, page, tok_no, text, conf, bbox_px, bbox) of pages that hold parallel
    arrays: text, conf, left, top, width, height, and the page's page_width and page_height."""
    words = F.arrays_zip("text", "conf", *SIDES)
    each = pages.select("doc_id", "page", "page_width", "page_height", F.posexplode(words).alias("tok_no", "w")).select("doc_id", "page", "page_width", "page_height", "tok_no", "w.*")
    x, y, w, h = (F.col(c).try_cast("int") for c in SIDES)
    boxed = each.where(F.trim("text") != "").withColumn("bbox_px", F.when((x + y + w + h).isNotNull(), F.array(x, y, x + w, y + h))).where("bbox_px is not null")
    sized = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    share = F.transform("bbox_px", lambda v, i: v / F.when(i % 2 == 0, F.col("page_width")).otherwise(F.col("page_height")))
    return boxed.select("doc_id", "page", "tok_no", F.trim("text").alias("text"), F.col("conf").try_cast("double").alias("conf"), "bbox_px", F.when(sized, share).alias("bbox"))


def first_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The pages (doc_id, page) of a document that are read, by their number."""
    return pages.where(F.col("page").between(1, most))


def page_image(images: DataFrame, preferred: DataFrame) -> DataFrame:
    """Of images (doc_id, path) the one of the preferred page (doc_id, page), else the first of a page, else the first PNG."""
    of_page = F.regexp_extract("path", r"_page_(\d+)\.png$", 1)
    ranked = images.join(preferred, "doc_id", "left").withColumn(
        "_rank", F.when(of_page.try_cast("int") == F.coalesce("page", F.lit(1)), 0).when(of_page != "", 1).when(F.lower("path").endswith(".png"), 2)
    )
    order = Window.partitionBy("doc_id").orderBy("_rank", "path")
    return ranked.where("_rank is not null").withColumn("_place", F.row_number().over(order)).where("_place = 1").select("doc_id", "path")


def missing(record: Column, required: tuple[str, ...]) -> Column:
    """The required fields that a record (a map) lacks or holds blank, in their order."""
    blank = lambda f: F.trim(F.coalesce(F.try_element_at(record, F.lit(f)), F.lit(""))) == ""
    return F.array_compact(F.array(*[F.when(blank(f), F.lit(f)) for f in required]))


def visual_confidence(record: Column) -> Column:
    """Confidence of the visual parser: its share of four fields and a bonus for the telling ones, at most 100."""
    held = F.map_keys(F.map_filter(record, lambda k, v: v.isNotNull()))
    share = F.size(F.filter(held, lambda k: k != "currency")) / VISUAL_FIELDS * 100
    bonus = sum((F.when(F.array_contains(held, f), b).otherwise(0) for f, b in VISUAL_BONUS.items()), F.lit(0))
    return F.round(F.least(share + bonus, F.lit(100.0)), 2)


def answer_confidence(scores: DataFrame) -> DataFrame:
    """Confidence of the question-answering producer: the mean of each field's best score (doc_id, field, score), the customer's included, in percent."""
    best = scores.where("score is not null").groupBy("doc_id", "field").agg(F.max("score").alias("score"))
    return best.groupBy("doc_id").agg(F.round(F.avg("score") * 100, 2).alias("confidence"))


def template_match(confidences: Column) -> Column:
    """Mean confidence of the fields that a template gave, 0 without any."""
    return F.when(F.size(confidences) > 0, F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c) / F.size(confidences)).otherwise(F.lit(0.0))


def setting_list(value: Column) -> Column:
    """A comma-separated setting as its trimmed parts that are not blank."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
