"""Pages of a document as one record, with its line items in page order.

Pages are (doc_id, page, invoice_number, total_amount, vendor_name), items (doc_id, page,
item_no, description, quantity, unit_price, amount). If the pages that name a number all name
the same, the first page's fields stand for the document and its items are those of all pages;
otherwise the first page is the record, with its own items, a mark, and a summary of the other
pages.

A record holds all its items and other pages. Where rows must stay small, ``most`` bounds both: they are
counted first, over sorted rows that may spill, and only what fits is collected; what does not is marked in the record
and given in full by :func:`overflow` and :func:`overflow_pages` in long form, so nothing is cut off.

Cases: empty and null numbers name none; a document without any number counts as several;
pages that repeat count once, the least of them stays; items whose page has no row belong to
the document and not to its first page; items of documents without pages are ignored; ties of
item numbers are ordered by the item's other columns; documents of one page are no multi-page ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("invoice_number", "total_amount", "vendor_name")
ITEM = ("item_no", "description", "quantity", "unit_price", "amount")


def _documents(pages: DataFrame) -> DataFrame:
    """Each document's number of pages, first page and whether it is one invoice."""
    single = pages.groupBy("doc_id", "page").agg(F.min(F.struct(*FIELDS)).alias("f"))
    number = F.nullif(F.col("f.invoice_number"), F.lit(""))
    docs = single.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.min(F.struct("page", "f")).alias("first"),
        F.min(number).alias("least"),
        F.max(number).alias("greatest"),
    )
    return docs.select("doc_id", "page_count", "first", F.coalesce(F.col("least") == F.col("greatest"), F.lit(False)).alias("single"))


def _own_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The items that a document's record takes."""
    kept = items.join(docs.select("doc_id", "page_count", "single", F.col("first.page").alias("first_page")), "doc_id")
    return kept.where("single or page_count = 1 or page = first_page").select("doc_id", "page", *ITEM)


def _within(rows: DataFrame, most: int, fits: bool) -> DataFrame:
    """The rows of documents that have at most ``most`` of them, or of the others."""
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts.where(F.col("_n") <= most if fits else F.col("_n") > most).select("doc_id"), "doc_id", "left_semi")


def _listed(rows: DataFrame, most: int | None, columns: tuple[str, ...], name: str) -> DataFrame:
    """(doc_id, n, list): rows counted for every document, and collected in order, where they fit if there is a bound."""
    if most is None:
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return counted.groupBy("doc_id").agg(
        F.max("_n").alias(f"n_{name}"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct(*columns)))).alias(name)
    )


def _other_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages but the first of documents that are several invoices."""
    several = docs.where("not single and page_count > 1").select("doc_id", F.col("first.page").alias("first_page"))
    rest = pages.groupBy("doc_id", "page").agg(F.min(F.struct(*FIELDS)).alias("f")).join(several, "doc_id").where("page > first_page")
    return rest.select("doc_id", "page", "f.*")


def records(pages: DataFrame, items: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, page_count, multipage, multiple_invoices, the first page's fields, n_items,
    line_items, n_other_pages, other_pages and overflowed (never without a bound ``most``)."""
    # pages and items are dealt once by document; all that follows keeps to that
    pages, items = pages.repartition("doc_id"), items.repartition("doc_id")
    docs = _documents(pages)
    lists = _listed(_own_items(docs, items), most, ("page", *ITEM), "line_items")
    others = _listed(_other_pages(docs, pages), most, ("page", *FIELDS), "other_pages")
    within = lambda n: F.lit(True) if most is None else n <= most
    none = lambda c, n: F.when(n == 0, F.array()).when(within(n), F.col(c))
    n_items, n_others = F.coalesce("n_line_items", F.lit(0)), F.coalesce("n_other_pages", F.lit(0))
    return docs.join(lists, "doc_id", "left").join(others, "doc_id", "left").select(
        "doc_id",
        "page_count",
        (F.col("page_count") > 1).alias("multipage"),
        ((F.col("page_count") > 1) & ~F.col("single")).alias("multiple_invoices"),
        *[F.col(f"first.f.{c}").alias(c) for c in FIELDS],
        n_items.alias("n_items"),
        none("line_items", n_items).alias("line_items"),
        n_others.alias("n_other_pages"),
        none("other_pages", n_others).alias("other_pages"),
        (~(within(n_items) & within(n_others))).alias("overflowed"),
    )


def overflow(pages: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(doc_id, place, page, item): the items of records that hold more than ``most``, in long form and in their order."""
    rows = _within(_own_items(_documents(pages), items), most, False)
    order = Window.partitionBy("doc_id").orderBy("page", *ITEM)
    return rows.select("doc_id", F.row_number().over(order).alias("place"), "page", *ITEM)


def overflow_pages(pages: DataFrame, most: int) -> DataFrame:
    """(doc_id, place, page, fields): the other pages of records that have more than ``most``, in long form and in their order."""
    rows = _within(_other_pages(_documents(pages), pages), most, False)
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("place"), "page", *FIELDS)


def concatenated(items: Column) -> Column:
    """Line items of a record as text, one a line: page, number and amount."""
    return F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["page"].cast("string"), i["item_no"].cast("string"), i["amount"].cast("string"))), "\n")
