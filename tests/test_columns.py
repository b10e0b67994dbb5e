"""Fields by pixel columns: labels of several words, neighbours, the line below, pages of many words."""

from pyspark.sql import functions as F

from fieldloom.operators import columns, layout
from fieldloom.plans import pages

TOKEN = "doc_id long, page int, source string, tok_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int"


def tokens(spark, lines, doc=1, source="paddle_v1"):
    """lines: lists of (x, text) or (x, text, conf)."""
    rows = []
    for k, line in enumerate(lines):
        for x, text, *conf in line:
            rows.append((doc, 1, source, len(rows), text, conf[0] if conf else 0.9, x, 30 * k, x + 8 * len(text or ""), 30 * k + 12))
    return spark.createDataFrame(rows, TOKEN)


def read(spark, *lines):
    found = columns.anchored_by_columns(layout.grouped_lines(tokens(spark, lines)))
    return {r["field"]: r["value"] for r in found.collect()}


def test_columns(spark):
    got = read(
        spark,
        [(0, "Invoice"), (70, "No."), (300, "Your"), (340, "Purchase"), (420, "Order"), (700, "Due"), (740, "Date"), (1000, "Grand"), (1060, "Total")],
        [(10, "A-17"), (330, "PO9B"), (700, "May"), (740, "3,"), (770, "2024"), (1010, "1,75"), (2000, "999")],
    )
    assert got == {"invoice_number": "A-17", "po_number": "P098", "due_date": "05/03/2024", "total_amount": "1.75"}
    assert read(spark, [(0, "Date"), (50, "printed"), (120, "01/02/2020")], [(0, "Date"), (60, "2/3/21")])["invoice_date"] == "2/3/21"


def test_the_first_line_with_a_value_counts(spark):
    assert read(spark, [(0, "Balance"), (60, "Due"), (400, "5")], [(0, "x")], [(0, "Total"), (60, "8.25")]) == {"total_amount": "8.25"}
    assert read(spark, [(0, "Total"), (60, "maybe")], [(0, "Total"), (60, "9")]) == {"total_amount": "9"}
    assert read(spark, [(0, "hello"), (60, "12")]) == {} == read(spark, [(0, None), (9, "")])


def test_confidence(spark):
    rows = [[(0, "Total"), (60, "7", None)], [(0, "PO"), (60, "B1", 80.0)]]
    found = columns.anchored_by_columns(layout.grouped_lines(tokens(spark, rows, source="tesseract_v3")))
    assert {r["field"]: r["score"] for r in found.collect()} == {"total_amount": 0.36, "po_number": 0.72}


def test_a_page_of_many_words(spark):
    """Labels meet the words of their buckets, not all words of the page."""
    lines = [[(0, "Total"), (60, str(n))] + [(300 + 60 * k, f"w{k}") for k in range(98)] for n in range(100)]
    words = columns.words_of_lines(layout.grouped_lines(tokens(spark, lines)))
    spans = columns.label_columns(words)
    assert words.count() == 10_000 and spans.count() == 100
    plan = spans.select(*columns.PAGE, "line_no", F.col("left_bound").alias("low"), F.col("right_bound").alias("high"))
    met = columns.within(words, plan, [*columns.PAGE, "line_no"], "centre", "low", "high")
    assert met.count() == 2 * 100  # the label itself and its amount
    text = met._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_within(spark):
    points = spark.createDataFrame([(1, float(x)) for x in range(-600, 600, 7)] + [(2, 5.0), (1, None)], "g int, at double")
    ranges = spark.createDataFrame([(1, 0, -300.0, 300.0), (1, 1, 0.0, 0.0), (1, 2, 255.0, 256.0), (1, 3, 9.0, 2.0), (2, 4, None, 9.0)], "g int, k int, low double, high double")
    got = sorted((r["k"], r["at"]) for r in columns.within(points, ranges, ["g"], "at", "low", "high").collect())
    assert got == sorted((k, x) for k, low, high in ((0, -300, 300), (1, 0, 0), (2, 255, 256)) for x in map(float, range(-600, 600, 7)) if low <= x <= high)


def test_forms_are_dealt_once(spark, folder):
    """Labels look through the words of their line and the next one in one row: no join by pixels, words gathered once."""
    text = pages.column_fields(spark, folder)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "_bucket" not in text and text.count("collect_list(") == 2 and text.count("ArrowEvalPython") == 1  # partial and final


def test_lines_of_pages(spark):
    """Lines told apart inside a page's row are those of tokens numbered one by one, at pages of any order and with empty boxes."""
    rows = [(d, 1, "s", k, f"w{k}", 0.5 + k, (k * 37) % 300, (k * k * 7) % 90 + d, (k * 37) % 300 + 20, (k * k * 7) % 90 + d + 8 + k % 5) for d in range(1, 6) for k in range(12 * d)]
    made = spark.createDataFrame(rows, TOKEN)
    plain = lambda df: sorted((r["doc_id"], r["line_no"], [tuple(w) for w in r["words"]], None if r["below"] is None else [tuple(w) for w in r["below"]]) for r in df.collect())
    got = plain(columns.lines_of_pages(made))
    assert got == plain(columns.lines_of_words(columns.words_of_lines(layout.grouped_lines(made)))) and len(got) > 20
