"""Submitted corrections, multi-page records, open records, header lines and cross-field codes on small tables."""

import datetime as dt
import json

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import records, text
from fieldloom.operators import header, multipage, submit, validate
from fieldloom.plans import flow

TOKEN = "doc_id long, page int, source string, tok_no int, text string, x0 int, y0 int, x1 int, y1 int"


def test_containing(spark):
    words = ["INV-7", "inv", "7", "Total  due", "total", "", None, "é", "x" * 50, "ab"]
    values = ["INV-7", "total due", "é", "", None, "xx", "abc", "7"]
    tokens = spark.createDataFrame([(d, 1, "s", k, w, 0, 0, 1, 1) for d in (1, 2) for k, w in enumerate(words)], TOKEN)
    asked = spark.createDataFrame([(1, f"f{k}", v) for k, v in enumerate(values)] + [(3, "f", "inv")], "doc_id long, field string, value string")
    key = lambda s: " ".join((s or "").lower().split())
    want = sorted((f"f{k}", n) for k, v in enumerate(values) for n, w in enumerate(words) if key(v) and key(w) and (key(v) in key(w) or key(w) in key(v)))
    assert sorted((r["field"], r["tok_no"]) for r in submit.containing(asked, tokens).collect()) == want


def test_submitted(spark):
    at = lambda n: dt.datetime(2024, 1, n)
    docs = spark.createDataFrame([(1, 5, {"total": "1", "note": "x"}, "EXTRACTED"), (2, None, {"total": "2"}, "EXTRACTED"), (3, 5, {}, "FAILED")], "doc_id long, vendor_id long, extracted_data map<string,string>, status string")
    given = spark.createDataFrame(
        [(1, {"total": "9"}, None, None, at(1)), (1, {"total": "10", "po": "A1"}, {"po": [0.0, 0.0, 1.0, 1.0]}, {"po": 3}, at(2)), (2, {"total": "2", "new": None}, None, None, at(3)), (9, {"total": "1"}, None, None, at(4))],
        "doc_id long, corrected map<string,string>, boxes map<string,array<double>>, pages map<string,int>, submitted_at timestamp",
    )
    tokens = spark.createDataFrame([(1, 2, "b", 0, "10", 10, 20, 30, 40), (1, 1, "a", 7, "10.", 0, 0, 5, 5), (1, 1, "a", 8, "end", 50, 0, 100, 50)], TOKEN)
    none = spark.createDataFrame([(5, "total", ["3"], 80.0, 1)], "vendor_id long, field string, examples array<string>, confidence double, occurrences long")
    out = submit.submitted(given, docs, tokens, none)
    assert {r["doc_id"]: (r["extracted_data"], r["status"]) for r in out["documents"].collect()} == {
        1: ({"total": "10", "po": "A1"}, "CORRECTED"), 2: ({"total": "2", "new": None}, "CORRECTED"), 3: ({}, "FAILED"),
    }
    got = {(r["doc_id"], r["field_name"]): (r["original_value"], r["corrected_value"], r["bbox"], r["page"]) for r in out["corrections"].collect()}
    assert got == {(1, "total"): ("1", "10", [0.0, 0.0, 0.05, 0.1], 1), (1, "po"): (None, "A1", [0.0, 0.0, 1.0, 1.0], 3)}
    assert {r["field"]: (r["examples"], r["occurrences"]) for r in out["template"].collect()} == {"total": (["3", "10"], 2), "po": (["A1"], 1)}
    assert [r["doc_id"] for r in submit.unknown(given, docs).collect()] == [9]


def test_halves_of_boxes(spark, tmp_path):
    """Shares of a page that lie at a half of the last place shown, or next to it, read as in SQL."""
    values = [a / b for b in (160, 176, 320, 352, 999) for a in range(b + 1)] + [0.03125, 0.09375, 0.123449999, 0.12345000001]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v"), 4).alias("s")).collect()
    assert [r["s"] for r in got] == [f"{r['v']:.4f}" for r in got]
    orders = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    rows = [(100005, 249, "F", 39577.85, dt.datetime(2000, 3, 27), "4"), (101050, 442, "F", 377876.53, dt.datetime(1997, 11, 12), "4")]
    spark.createDataFrame(rows, orders).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert compare.rows(flow.correction_submit(spark, str(tmp_path)).toPandas()) == compare.rows(c.sql(flow.ORACLES["correction_submit"]).df())


PAGE = "doc_id long, page int, invoice_number string, total_amount string, vendor_name string"
ITEM = "doc_id long, page int, item_no int, description string, quantity double, unit_price double, amount string"


def test_pages(spark):
    pages, items, want = [], [], {}
    for doc in range(1, 51):  # documents of 1 to 50 pages
        for p in range(1, doc + 1):
            number = None if p % 3 == 0 else f"N{doc}" if doc % 2 or p == 1 else f"M{p}"
            pages.append((doc, p, number, str(p), "V"))
            items += [(doc, p, k, "d", 1.0, None, f"{p}.{k}") for k in (2, 1)]
        single = doc % 2 == 1 or doc == 1
        mine = [(p, k) for p in range(1, doc + 1) for k in (1, 2)] if single else [(1, 1), (1, 2)]
        want[doc] = (doc, not single and doc > 1, mine, [] if single else list(range(2, doc + 1)))
    pages += [(60, 2, "", None, None), (60, 2, "", None, None), (61, 1, None, "5", "V"), (61, 2, "", "6", None)]
    items += [(60, 1, 1, None, None, None, None), (99, 1, 1, None, None, None, None)]
    shuffled = spark.createDataFrame(pages[::-1], PAGE).repartition(3), spark.createDataFrame(items[::-1], ITEM)
    got = {r["doc_id"]: r for r in multipage.records(*shuffled, most=40).collect()}
    assert got.keys() == want.keys() | {60, 61}
    for doc, (count, several, mine, others) in want.items():
        r = got[doc]
        assert (r["page_count"], r["multiple_invoices"], r["multipage"], r["invoice_number"], r["n_items"]) == (count, several, count > 1, f"N{doc}", len(mine))
        assert r["overflowed"] == (len(mine) > 40 or len(others) > 40)
        assert r["line_items"] is None if len(mine) > 40 else [(i["page"], i["item_no"]) for i in r["line_items"]] == mine
        assert r["other_pages"] is None if len(others) > 40 else [p["page"] for p in r["other_pages"]] == others
    assert (got[60]["page_count"], got[60]["multipage"], got[60]["n_items"]) == (1, False, 1)
    assert got[61]["multiple_invoices"] and [p["page"] for p in got[61]["other_pages"]] == [2]
    rest = [(r["doc_id"], r["place"], r["page"], r["item_no"]) for r in multipage.overflow(*shuffled, most=40).orderBy("doc_id", "place").collect()]
    assert rest == [(d, n, p, k) for d, (_, _, mine, _) in want.items() if len(mine) > 40 for n, (p, k) in enumerate(mine, 1)]
    assert multipage.records(spark.createDataFrame([], PAGE), spark.createDataFrame([], ITEM)).count() == 0


def test_records_hold_all_pages(spark, tmp_path):
    """Without a bound nothing is left out of a record; with one the other pages stand in long form as well as the items."""
    pages = spark.createDataFrame([(1, p, f"N{p}", str(p), "V") for p in range(60, 0, -1)] + [(2, p, "N", "1", "V") for p in (2, 1)], PAGE)
    items = spark.createDataFrame([(d, p, k, "d", 1.0, None, f"{p}.{k}") for d, p in ((1, 1), (2, 2), (2, 1)) for k in range(1500, 0, -1)], ITEM)
    got = {r["doc_id"]: r for r in multipage.records(pages, items).collect()}
    assert [p["page"] for p in got[1]["other_pages"]] == list(range(2, 61)) and got[2]["other_pages"] == []
    assert [(i["page"], i["item_no"]) for i in got[2]["line_items"]] == [(p, k) for p in (1, 2) for k in range(1, 1501)]
    assert len(got[1]["line_items"]) == 1500 and not got[1]["overflowed"] and not got[2]["overflowed"]
    rest = multipage.overflow_pages(pages, 58).orderBy("place").collect()
    assert [(r["doc_id"], r["place"], r["page"], r["invoice_number"]) for r in rest] == [(1, n, n + 1, f"N{n + 1}") for n in range(1, 60)]
    assert multipage.overflow_pages(pages, 59).count() == 0
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame([(k, 1, k, n, float(n), 10.5 * n) for k in range(7, 24) for n in range(1, 8)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = flow.multipage_records(spark, str(tmp_path)).toPandas()
    assert compare.rows(found) == compare.rows(c.sql(flow.ORACLES["multipage_records"]).df())
    assert found["items"].notna().all() and found["others"].notna().all() and found["overflowed"].any()
    assert [len(x.split("\n")) for x in found["items"]] == found["n_items"].tolist()


@pytest.mark.parametrize(
    "left, right",
    [({"a": 1, "b": {"c": [1, 2], "d": None}}, {"a": 2, "z": [{"q": 1}], "b": 5}), (None, {"k": 1}), ([1], "s"), ({}, {}), ({"b": None}, {"b": {"t": 1}}), ({"x y": "é"}, None), ({"a": {"b": {"c": 1}}}, {"a": [1]})],
)
def test_open_records(spark, left, right):
    own = lambda v: v if isinstance(v, dict) else {}
    text = lambda v: None if v is None else json.dumps(v)
    row = spark.createDataFrame([(text(left), text(right))], "l string, r string")
    a, b = records.record(F.col("l")), records.record(F.col("r"))
    shown = lambda c: json.loads(row.select(records.shown(c)).first()[0])
    assert shown(records.right_wins(a, b)) == own(left) | own(right)
    assert shown(records.left_wins(a, b)) == own(right) | own(left)
    put = dict(own(left))
    put["a"] = {**own(put.get("a")), "n": 7}
    assert shown(records.path_set(a, "a.n", records.variant(F.lit(7)))) == put
    assert shown(records.carried(a, b, ("a", "b"))) == {k: v for k, v in own(right).items() if k not in ("a", "b")} | own(left)
    got = row.select(records.path_get(a, "b.c.1", "int"), records.path_get(a, "a.b.c", "int"), records.path_get(a, "no.way")).first()
    assert tuple(got) == (2 if own(left).get("a") == 1 else None, 1 if own(left).get("a") == {"b": {"c": 1}} else None, None)


def test_headers(spark):
    def read(text, confidence=60.0):
        rows = header.scored_fields(spark.createDataFrame([(1, text, confidence)], "doc_id long, text string, confidence double"))
        return {r["field"]: (r["value"], r["confidence"]) for r in rows.collect()}

    assert read("Labor Total: $9.00\nTotal: 12.50\ntax total 3.10")["total_amount"] == ("12.50", 70.0)
    assert read("Total: 12.50\nBalance Due: 1,000")["total_amount"] == ("1000", 75.0)
    assert "total_amount" not in read("parts total 7.00\nsubtotal 5.00")
    assert read("\n\nCUSTOMER\nACME, INC")["vendor_name"] == ("ACME, INC", 70.0)
    assert read("invoice # 01/02/2003\n#AB123", 99.0)["invoice_number"] == ("AB123", 84.0)
    assert read("on 13/14/2004 or 2004-02-30, 2005/06/07")["invoice_date"] == ("2005-06-07", 60.0)
    assert read("date: 25-12-2024", 95.0)["invoice_date"] == ("2024-12-25", 100.0) and "invoice_date" not in read("date: 1/1/1999")
    assert read(None) == {} and read("", None) == {"currency": ("USD", 95.0)}


def test_cross_field_codes(spark):
    schema = "doc_id long, text string, vendor_name string, customer_name string, invoice_number string, invoice_date string, due_date string, total_text string, currency string, confidences map<string,double>"
    fields = spark.createDataFrame([(k, "Invoice", "Acme Inc", None, "INV-77", "2024-01-02", None, t, "USD", {"total_amount": 90.0}) for k, t in enumerate(["1200.00", "1250.00", "1200.00", "99.01", "0.00", "1200.00", None])], schema)
    items = spark.createDataFrame([(0, 1200.0), (1, 1000.0), (2, None), (3, 99.0), (4, 5.0), (5, 600.0), (5, 600.01), (6, 1.0)], "doc_id long, amount double")
    known = spark.createDataFrame([(0, "ACME"), (1, "Zenith"), (2, " acme inc "), (3, None), (5, "Acme Inc Ltd")], "doc_id long, vendor_name string")
    found = validate.validated(validate.with_items_and_vendors(fields, items, known), F.lit("2024-06-01").cast("timestamp"))
    cross = ("items_differ", "differs_from_items", "very_round", "vendor_mismatch")
    got = {r["doc_id"]: [c for c in r["codes"].split(",") if c in cross] for r in found.collect()}
    assert got == {0: ["very_round"], 1: ["items_differ", "differs_from_items", "vendor_mismatch"], 2: ["items_differ", "differs_from_items"], 3: [], 4: [], 5: ["very_round"], 6: []}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 3  # fields, items and vendors, each dealt once
