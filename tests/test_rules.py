"""Scalar rules, votes and layout on small tables of known results."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.operators import consensus, extract, fusion, layout, serve, templates, validate, vendors
from fieldloom.sources import files


def column(spark, values, rule, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, v {kind}")
    return [r[0] for r in rows.select(rule(F.col("v")).alias("r"), "k").orderBy("k").collect()]


def test_decimals(spark):
    written = ["1,750.00", "824,13", "1.750,00", "1 750,00", "12.345", "$99.50", "abc", "", None, "12d", "-5.25", "1.2.3"]
    want = [1750.0, 824.13, 1750.0, 1750.0, 12345.0, 99.5, None, None, None, None, -5.25, None]
    assert column(spark, written, money.decimal_value) == want


def test_dates(spark):
    written = ["05/12/2025", "25/12/2025", "02/30/2025", "31/04/2025", "2025", "Nov 35, 2025", "2025-02-07", "7 March 2024", "20240229", "1/2/49", "1/2/51", None, ""]
    want = ["2025-05-12", "2025-12-25", "2025-02-28", None, None, "2025-11-30", "2025-02-07", "2024-03-07", "2024-02-29", None, None, None, None]
    assert column(spark, written, dates.cleaned) == want


def test_vendor_keys(spark):
    names = ["Hankook Tire America Corp.", "Belle Tire RECEIPT", "Northwind Traders", "Contoso Corporation", "", None]
    assert column(spark, names, text.vendor_key) == ["hankooktireamerica", "belletire", "northwdtraders", "ntosoori", "", ""]
    assert column(spark, names[-2:], text.fingerprint) == [None, None]


@pytest.mark.parametrize("n, most, level", [(4, 4, "unanimous"), (4, 3, "strong"), (4, 2, "moderate"), (4, 1, "conflict"), (5, 5, "conflict"), (3, 2, "strong"), (2, 1, "conflict"), (1, 1, "weak"), (0, 0, "none")])
def test_agreement(spark, n, most, level):
    assert spark.range(1).select(consensus.agreement(F.lit(n), F.lit(most))).first()[0] == level


VOTES = "doc_id long, voter string, voter_ord int, field string, value string, confidence double"


@pytest.mark.parametrize(
    "field, votes, want",
    [
        ("total_amount", [("docling", 90, "A"), ("impira", 85, "A"), ("layoutlm", 88, "A"), ("donut", 82, "B")], ("a", "strong", 99.0)),
        ("vendor_name", [("impira", 60, "X"), ("donut", 70, "Y")], ("y", "conflict", 37.9)),
        ("currency", [("impira", 75, "USD")], ("usd", "weak", 63.8)),
        ("due_date", [("docling", 50, "A"), ("impira", 90, "B")], ("a", "conflict", 33.0)),
        ("currency", [("docling", 50, None), ("impira", 90, None)], ("", "unanimous", 99.0)),
    ],
)
def test_votes(spark, field, votes, want):
    rows = [(1, v, k, field, value, float(c)) for k, (v, c, value) in enumerate(votes)]
    r = consensus.field_vote(spark.createDataFrame(rows, VOTES)).first()
    assert (r["value"], r["agreement"]) == want[:2]
    assert r["confidence"] == pytest.approx(want[2], abs=0.11)


@settings(max_examples=8, deadline=None)
@given(st.permutations(range(5)), st.lists(st.sampled_from("AbB "), min_size=5, max_size=5))
def test_vote_order_does_not_matter(spark, order, values):
    names = ["docling", "impira", "layoutlm", "donut", "ocr_fused"]
    rows = [(1, names[k], k, "currency", values[k], 60.0 + k) for k in range(5)]
    a = consensus.field_vote(spark.createDataFrame(rows, VOTES)).first()
    b = consensus.field_vote(spark.createDataFrame([rows[k] for k in order], VOTES)).first()
    assert a == b and 10 <= a["confidence"] <= 99


def test_empty_votes(spark):
    assert consensus.field_vote(spark.createDataFrame([], VOTES)).count() == 0


def test_cells_of_sample(spark):
    cells = [("INVOICE No", 0, 0), ("INV-2026-0842", 0, 1), ("Date: 08/03/2026", 1, 0), ("2026-08-03", 2, 0), ("From: Northwind Traders", 3, 0), ("Subtotal: 3,451.75", 4, 0), ("TOTAL: 3,750.00", 5, 0), ("Vendor: Sample", 6, 0)]
    rows = spark.createDataFrame([(1, r, c, v) for v, r, c in cells], "doc_id long, row int, col int, value string")
    got = {r["field"]: r["value"] for r in extract.from_cells(rows).collect()}
    assert got["invoice_number"] == "2026-0842"
    assert got["vendor_name"] == "Northwind Traders"
    assert float(got["total_amount"]) == 3451.75
    assert got["invoice_date"] == "2026-08-03"


def test_totals_of_text(spark):
    body = "Payment terms: 100.00, 200.00 and 700.00"
    assert spark.range(1).select(extract.schedule_total(F.lit(body), F.lit(1.0))).first()[0] == 700.0
    one = spark.range(1).select(extract.addresses(F.lit("12 Main Street, Springfield, IL 62701 and 9 Oak Ave, Dover, DE 19901"))).first()[0]
    assert one["vendor_address"].startswith("12 Main") and one["customer_address"].startswith("9 Oak")


def test_lines_drift():
    assert layout.lines_of([0, 2, 30, 8], [10, 12, 40, 18]) == [0, 0, 1, 0]


def test_line_items(spark):
    words = [("Description", 0, 0), ("Qty", 1, 0), ("Amount", 2, 0), ("bolt", 0, 1), ("2", 1, 1), ("1,250.00", 2, 1), ("nut", 0, 2), ("3", 1, 2), ("9.50", 2, 2), ("Total", 0, 3), ("1,259.50", 2, 3)]
    rows = [(1, 1, "tesseract_v3", k, w, 0.9, p * 150, y * 40, p * 150 + 60, y * 40 + 12) for k, (w, p, y) in enumerate(words)]
    tokens = spark.createDataFrame(rows, "doc_id long, page int, source string, tok_no int, text string, conf double, x0 int, y0 int, x1 int, y1 int")
    got = [(r["description"], r["quantity"], r["amount"]) for r in layout.line_items(layout.grouped_lines(tokens)).orderBy("item_no").collect()]
    assert got == [("bolt", 2.0, 1250.0), ("nut", 3.0, 9.5)]
    assert layout.footer_totals(tokens).first()["value"] == "1,259.50"


def test_fusion_and_override(spark):
    candidates = spark.createDataFrame([(1, "total_amount", "9.00", 0.5, 0), (1, "total_amount", "8.00", 0.9, 1), (1, "due_date", "x", 0.9, 0)], "doc_id long, field string, value string, score double, ord int")
    got = {r["field"]: (r["value"], r["fused_confidence"]) for r in fusion.fused(candidates).collect()}
    assert got == {"total_amount": ("8.00", 90.0), "due_date": ("x", 90.0)}
    votes = spark.createDataFrame([(1, "ocr_fused", 5, "invoice_date", "2025-01-02", 60.0), (1, "donut", 3, "invoice_date", "??", 90.0)], VOTES)
    assert fusion.overrides(votes).first()["value"] == "2025-01-02"


def test_corrections_win(spark):
    docs = spark.createDataFrame([(1, {"total": "1", "_x": "i"}, "EXTRACTED"), (2, {"total": "2"}, "FAILED")], "doc_id long, extracted_data map<string,string>, status string")
    fixes = spark.createDataFrame([(1, 1, "total", "5", dt.datetime(2024, 1, 1)), (2, 1, "total", "7", dt.datetime(2024, 1, 2))], "id int, doc_id long, field_name string, corrected_value string, created_at timestamp")
    got = {r["doc_id"]: (r["extracted_data"]["total"], r["status"]) for r in serve.corrected(docs, fixes).collect()}
    assert got == {1: ("7", "CORRECTED"), 2: ("2", "FAILED")}
    one = serve.detail(docs).orderBy("doc_id").first()
    assert one["fields"] == {"total": "1"} and one["internal"] == {"_x": "i"} and one["progress"] == 100


def test_vendor_upsert_renames_only_for_more(spark):
    old = spark.createDataFrame([(1, "Acme", "x", 80.0, 3, dt.datetime(2024, 1, 1))], "id int, vendor_name string, k string, confidence double, invoice_count int, last_seen timestamp").withColumn("vendor_fingerprint", text.fingerprint(F.col("vendor_name")))
    docs = spark.createDataFrame([(1, "ACME Inc", 80.0, dt.datetime(2024, 2, 1)), (2, "New One", 5.0, dt.datetime(2024, 2, 1)), (3, None, 99.0, dt.datetime(2024, 2, 1))], "doc_id long, vendor_name string, confidence double, seen_at timestamp")
    got = vendors.upserted(old, docs).collect()
    assert [(r["vendor_name"], r["invoice_count"]) for r in got] == [("Acme", 4)]


def test_profiles_and_codes(spark):
    expected = templates.profile(F.lit("invoice_number"), F.lit("INV-2024-00123"))
    got = spark.range(1).select(templates.corruption(F.lit("-2024-00123"), expected)).first()[0]
    assert got == ["missing_prefix"]


def test_review_of_credit_note(spark):
    kind = spark.range(1).select(validate.document_type(F.lit("CREDIT NOTE 5"), F.lit(None).cast("double"))).first()[0]
    assert tuple(kind) == ("credit_note", 90.0)


def test_admission(spark):
    rows = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.csv", 0), ("d.png", 11 << 20)], "path string, size long")
    got = [tuple(r) for r in rows.select(files.kind(F.col("path")), files.rejection(F.col("path"), F.col("size"))).collect()]
    assert got == [("pdf", None), ("unknown", "unknown_kind"), ("csv", "empty"), ("image", "too_large")]


def test_csv_files(spark, tmp_path):
    wide = ",".join(f"v{k}" for k in range(90))
    (tmp_path / "a.csv").write_text(f'Invoice,INV-2024-77\nFrom:,\n\n\'x\',"1,5"\na,"two\nlines, and ""more""",c\n{wide}\n')
    (tmp_path / "b.csv").write_text("only\n")
    cells = {(r["path"][-5:], r["row"], r["col"]): r["value"] for r in files.csv_cells(spark, str(tmp_path)).collect()}
    assert cells["a.csv", 2, 1] == "1,5" and cells["a.csv", 3, 1] == 'two\nlines, and "more"' and cells["a.csv", 3, 2] == "c"
    assert cells["a.csv", 4, 89] == "v89" and cells["b.csv", 0, 0] == "only" and len(cells) == 2 + 1 + 2 + 3 + 90 + 1
    assert files.ingested(spark, str(tmp_path)).first()["status"] == "UPLOADED"


def test_labels_by_meaning(spark):
    from fieldloom.operators import labels

    lines = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8])], "line_id long, vector array<double>")
    words = spark.createDataFrame([("total_amount", [1.0, 0.1]), ("due_date", [-1.0, 0.5])], "field string, vector array<double>")
    got = {r["line_id"]: r["field"] for r in labels.by_meaning(lines, words).collect()}
    assert got == {1: "total_amount", 3: "total_amount"}
    labels.WORDS, held = 1, labels.WORDS  # a vocabulary of several blocks
    assert {r["line_id"]: r["field"] for r in labels.by_meaning(lines, words).collect()} == got
    labels.WORDS = held
    seen = column(spark, ["Subtotal: 5", "Grand Total 9", "Due date 1/2/2024", "nothing"], labels.rule_labels)
    assert seen == [[], ["total_amount"], ["due_date"], []]


def test_display_forms(spark):
    assert column(spark, [0, 512, 1536, 5 << 20], text.file_size, "long") == ["0 Bytes", "512 Bytes", "1.5 KB", "5 MB"]
    assert column(spark, [250.0, 12_345.0, 125_000.0], dates.duration, "double") == ["250ms", "12.3s", "2m 5s"]
    assert column(spark, ["ON_HOLD"], text.title) == ["On Hold"]
    assert column(spark, ["net 30 days", "NET 400", "none"], dates.terms_days) == [30, None, None]
    assert column(spark, ["Invoice: AB-12", "12-05-2024", "no", "#  77-A"], text.number_clean) == ["AB-12", None, None, "77-A"]
    assert column(spark, ["O1-l2", "--"], text.id_normalise) == ["01-12", None]


def test_recovered_dates(spark):
    texts = ["Invoice Date: March 5, 2008", "Terms\nDate: 28, 2008 in April", "Payment due 03/04", "nothing", "", None]
    labels = dates.INVOICE_DATE_LABELS
    assert column(spark, texts, lambda c: dates.labelled(c, labels)) == ["March 5, 2008", "28, 2008", None, None, None, None]
    assert column(spark, texts, lambda c: dates.monthless(c, labels)) == ["Mar 5, 2008", "Apr 28, 2008", None, None, None, None]
    assert column(spark, texts, lambda c: dates.recovered(c, labels, None, F.lit(None).cast("int"))) == ["2008-03-05", "2008-04-28", None, None, None, None]


def test_dates_in_lines(spark):
    lines = ["due 3rd of may", "May 3rd, 2021 x", "3 May 21", "on 1 2 2021", "on 1 2/2021", "no 2021-02-03 here", "13.2.2021", "", None]
    want = [None, "05/03/2021", "05/03/2021", "1/2/2021", "1/2/2021", "02/03/2021", None, None, None]
    assert column(spark, lines, dates.in_line) == want


def test_simple_cleaning(spark):
    assert column(spark, ["on 2020-01-02", "01/02/2020", "01-02-2020", "x ", None], dates.simple) == ["2020-01-02", "2020-01-02", "2020-01-02", "x", ""]
    assert column(spark, ["usd", "about eur", "12", "", None], text.currency_clean) == ["USD", "ABO", "USD", "USD", "USD"]
    assert column(spark, ["--A  1", " 7 ", "", None], text.number_simple) == ["A 1", "7", "", ""]
    assert column(spark, ["1,234.50 and 2.00", "-5,25", "10", None], money.cropped_amount) == ["1234.50", "-5.25", None, None]
    assert column(spark, ["l2,5O", "abc", None], money.fused_amount) == ["12.50", None, None]
    assert column(spark, ["48226", "48226 ", "4822", None], lambda c: text.zip_like(c, F.lit("Troy MI 48226"))) == [True, True, False, None]


def test_zip_total_is_overridden(spark):
    votes = spark.createDataFrame([(1, "ocr_fused", "total_amount", "120", 40.0), (1, "donut", "total_amount", "48226", 90.0), (1, "impira", "total_amount", "12.50", 90.0), (2, "ocr_fused", "total_amount", "120", 40.0), (2, "donut", "total_amount", "48226", 90.0), (2, "impira", "total_amount", "12.50", 90.0)], "doc_id long, voter string, field string, value string, confidence double")
    texts = spark.createDataFrame([(1, "Troy MI 48226"), (2, "total 48226"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, float(r.value)) for r in fusion.overrides(votes, texts=texts).collect()] == [(1, 120.0)]
    assert fusion.overrides(votes).count() == 0


def test_merge_branches(spark):
    votes = spark.createDataFrame([(1, "docling", 0, "a", "x", 90.0)], "doc_id long, voter string, voter_ord int, field string, value string, confidence double")
    forced = spark.createDataFrame([(1, "a", "y", 85.0), (1, "b", None, 85.0), (2, "c", "z", 85.0)], "doc_id long, field string, value string, confidence double")
    fused = spark.createDataFrame([(1, "a", "w")], "doc_id long, field string, value string")
    got = {(r.doc_id, r.field): (r.value, r.agreement) for r in consensus.n_way(votes, forced, fused).collect()}
    assert got == {(1, "a"): ("y", "forced_template"), (2, "c"): ("z", "forced_template")}
    assert consensus.n_way(votes, forced.limit(0), fused).first()["value"] == "w"
    assert consensus.n_way(votes.limit(0), forced.limit(0), fused.limit(0)).count() == 0


def test_learned_examples_are_the_last_five(spark):
    old = spark.createDataFrame([(1, "f", ["a", "b"], 50.0, 2)], "vendor_id long, field string, examples array<string>, confidence double, occurrences long")
    new = spark.createDataFrame([(1, "f", v, 40.0 + k, k) for k, v in enumerate("bcdef")] + [(1, "_i", "x", 1.0, 1), (2, "f", None, 1.0, 1)], "vendor_id long, field string, value string, confidence double, seen long")
    assert [tuple(r) for r in templates.learned(old, new).collect()] == [(1, "f", ["b", "c", "d", "e", "f"], 50.0, 7)]
    assert templates.learned(old, new.limit(0)).first()["examples"] == ["a", "b"]


def test_vendor_in_the_wrong_section(spark):
    rows = spark.createDataFrame([("Blue Harbor Works", None, "From: Red Lake Mill\nBill To: Blue Harbor Works"), ("John Smith", "Acme", "Widget Group\nx"), ("John Smith", "Acme", "x"), ("", "Acme", ""), ("Acme", "ACME", None)], "v string, c string, t string")
    s = validate.vendor_suggestion(F.col("v"), validate.vendor_check(F.col("v"), F.col("c")), F.col("t"))
    assert [tuple(r[0]) for r in rows.select(s).collect()] == [("Red Lake Mill", "wrong_section"), ("Widget Group", "person"), (None, "person"), (None, "missing"), (None, "equals_customer")]
