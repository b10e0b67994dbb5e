"""What keeps queries within bounds on large tables, seen on small ones."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import consensus, header, layout, submit
from fieldloom.plans import checks, fields, flow, headers, reading, render

pytestmark = pytest.mark.usefixtures("spark")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_submissions_are_no_broadcast(spark, folder):
    """Files of documents are small, their tokens are not."""
    docs = render.documents(spark, folder)
    given = docs.selectExpr("doc_id", "map('total', amount_text, 'none', '~') as corrected", "cast(null as map<string,array<double>>) as boxes", "cast(null as map<string,int>) as pages", "current_timestamp() as submitted_at")
    found = submit.anchors(given, render.tokens(spark, folder))
    assert "Broadcast" not in plan_of(found)
    assert {r["field"] for r in found.collect()} == {"total"}


def test_open_records_are_parsed_once(spark, folder):
    """Nested rules of records do not repeat what they are given."""
    text = flow.open_records(spark, folder)._jdf.queryExecution().analyzed().toString()
    assert text.count("try_parse_json(") == 2


def test_item_pages_are_dealt_once(spark, folder):
    """The header of a page comes with its first line: no second reading of the lines, no union."""
    text = plan_of(reading.item_tokens(spark, folder)).split("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "Union" not in text


def test_pages_pass_python_as_columns():
    """Whole Arrow columns, with empty pages and slices of a batch."""
    made = pa.array([[], [0, 2, 30, 8], [5], [], [7, 90]], pa.list_(pa.int32()))
    ends = pa.array([[], [10, 12, 40, 18], [9], [], [11, 94]], pa.list_(pa.int32()))
    assert layout._line_numbers(made, ends).to_pylist() == [[], [0, 0, 1, 0], [0], [], [0, 1]]
    assert layout._line_numbers(made[2:], ends[2:]).to_pylist() == [[0], [], [0, 1]]
    names = ("y0", "x0", "tok_no", "text", "conf", "x1", "y1", "line_no")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
    words = [("Part", "Qty", "Amount"), ("bolt", "2", "$1.234,50"), ("nut", "3", "7.00"), ("Total", "", "9.00"), ("rest", "x", "y")]
    page = [(40 * k, 100 * n, 10 * k + n, w, 0.9, 100 * n + 50, 40 * k + 10, k) for k, line in enumerate(words) for n, w in enumerate(line)]
    tokens = pa.array([[], [dict(zip(names, t)) for t in page[::-1]], [dict(zip(names, page[0]))]], pa.list_(pa.struct(list(zip(names, kinds)))))
    want = [[("bolt", 2.0, 1234.5, 0.9), ("nut", 3.0, 7.0, 0.9)], []]
    got = lambda a: [[(i["description"], i["quantity"], i["amount"], i["confidence"]) for i in p] for p in a.to_pylist()]
    assert got(layout._items(tokens)) == [[], *want] and got(layout._items(tokens[1:])) == want


def exchanges(df):
    return plan_of(df).split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_votes_are_dealt_once_by_document(spark, folder):
    """The vote and what is grouped by document after it share one shuffle, and no window sorts the keys again."""
    merged = consensus.merged(consensus.field_vote(render.votes(spark, folder)))
    assert exchanges(merged) == 1 and "Window" not in plan_of(merged)


def test_tables_of_items_are_dealt_once(spark, folder):
    """Header, body and sums of a table need no join and no second reading of the lines."""
    found = checks.table_items(spark, folder)
    assert exchanges(found) == 1 and "Join" not in plan_of(found)


def test_tokens_meet_values_unsorted(spark, folder):
    """Documents are dealt before they become tokens, and tokens are not sorted for the join."""
    text = plan_of(reading.token_match(spark, folder)).split("Initial Plan")[0]
    assert "ShuffledHashJoin" in text and 0 <= text.index("Generate") < text.index("Exchange")


def test_columns_of_numbers_take_one_sort(spark, folder):
    assert plan_of(reading.token_column_clusters(spark, folder)).split("Initial Plan")[0].count("Sort [") == 1


def test_lines_of_pages_are_dealt_once(spark, folder):
    """Lines are built after the deal, not by whole input splits, and pages need no second one."""
    assert exchanges(fields.totals_in_region(spark, folder)) == 1


def test_pages_are_dealt_by_document_alone(spark, folder):
    """Repeated pages, counts and lists keep to the deal by document."""
    text = plan_of(flow.multipage_records(spark, folder)).split("Initial Plan")[0]
    assert "LeftSemi" not in text and all(", page" not in keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", text))


def test_dates_of_candidates_throw_nothing(spark):
    """Forms are told apart before they are read: no attempt that fails by an exception."""
    rows = spark.createDataFrame([(v,) for v in ("2-9-2024", "13/02/2024", "30-02-2024", "29/2/2024", "2024/1/5", "01-02/2024", "1/2/24", "05-06-1999", None)], "v string").select(header.dated(F.col("v")).alias("d"))
    assert [r["d"] for r in rows.collect()] == ["2024-02-09", "2024-02-13", None, "2024-02-29", "2024-01-05", None, None, None, None]
    assert "timestamp" not in rows._jdf.queryExecution().analyzed().toString()


def test_patterns_of_candidates_are_searched_once(spark, folder):
    """No rule searches the text again for what it names, and texts are made by more tasks than a file has splits."""
    found = headers.scored_candidates(spark, folder)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert [text.count(p) for p in (header.ORDER, *(p for p, _ in header.NUMBERS), *header.NAMED_TOTALS, header.NAMED_DATE, header.LINE_TOTAL)] == [1] * 9
    assert exchanges(found) == 1


def test_candidates_that_find_nothing_leave_the_others(spark):
    """The next candidate counts where the better one is a date, no number or vetoed."""
    text = "\n \t\nacme\nNORTH 12\nInvoice # 01/02/2003\norder # 12345\nbalance due: ,\nTax total 1.00\ntOtAl 2,000.50\n99/99/2001 05-06-2007"
    rows = spark.createDataFrame([(1, text, 95.0), (2, None, 1.0), (3, "", None)], "doc_id long, text string, confidence double")
    assert sorted((r["doc_id"], r["field"], r["value"], r["confidence"]) for r in header.scored_fields(rows).collect()) == [
        (1, "currency", "USD", 95.0), (1, "invoice_date", "2003-01-02", 95.0), (1, "invoice_number", "12345", 90.0),
        (1, "total_amount", "2000.50", 100.0), (1, "vendor_name", "NORTH", 100.0), (3, "currency", "USD", 95.0),
    ]


def test_votes_stay_where_their_documents_lie(spark, folder):
    """Orders are dealt before they vote: neither votes nor documents are shuffled by field or with their vendor."""
    text = plan_of(flow.template_refresh(spark, folder)).split("Initial Plan")[0]
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert not [k for k in keys if re.match(r"doc_id#\d+L, (field|vendor_id)", k)] and sum(k.startswith("doc_id") for k in keys) == 1
    assert text[: text.index("Union")].count("ObjectHashAggregate(") == 2 and "Exchange" not in text[: text.index("Union")]


def test_votes_without_order_or_confidence(spark):
    """Sums pass over nulls, and a field whose votes have no confidence still has a winner."""
    votes = [(1, "a", 1, "f", "X", 80.0), (1, "b", 2, "f", "x ", None), (1, "docling", 0, "f", "y", 60.0), (2, "a", None, "f", None, None), (2, "b", 3, "f", "z", None)]
    rows = consensus.field_vote(spark.createDataFrame(votes, "doc_id long, voter string, voter_ord int, field string, value string, confidence double"))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert (got[1]["value"], got[1]["agreement"], got[1]["selected_from"], got[1]["all_values"], got[1]["vote_counts"]) == ("x", "strong", ["a", "b"], ["y", "x"], {"x": 2, "y": 1})
    assert got[1]["original"] == "X" and got[2]["vote_counts"] == {"": 1, "z": 1}


def test_words_of_columns_are_bounded_by_task(spark, folder, monkeypatch):
    """Documents are dealt before they become words, to more tasks where there are more documents."""
    monkeypatch.setattr(reading, "DOCUMENTS_OF_TASK", 100)
    found = reading.token_column_clusters(spark, folder)
    text, n = plan_of(found).split("Initial Plan")[0], render.documents(spark, folder).count()
    assert text.count("Exchange") == 1 and f", {-(-n // 100)}), REPARTITION_BY_NUM" in text and n > 1000
    assert text.index("Generate") < text.index("Exchange")


def test_texts_are_searched_whole(spark, folder):
    """No text is split into all its lines, none is made twice for a filter on the rows of it, and few bytes do not join the tasks that make them."""
    for query in (headers.scored_candidates, headers.header_lines):
        found = query(spark, folder)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("array_join(") == 1 and "size(" not in plan
        assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "split(" not in headers.scored_candidates(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_of_long_runs_and_vetoed_lines(spark):
    """White space of any length is read once; a veto after the total counts, a line's other dates are tried in their order."""
    gap = " " * 100_000
    text = f"\tCUSTOMER \nBILL TO\n AB  x\nNOVA & CO  9\nTotal 1.00 parts total\nsub total: 2.50\npo{gap}\ninvoice{gap}\ntotal{gap}\n2024-02-29-01-2024/2023-01-05 99-01-2007-03-04"
    rows = spark.createDataFrame([(1, text, 50.0), (2, "É9ÉÀÎÔ x\nÉCOLE\nAB", 50.0), (3, "date: 30/02/2024 29/02/2023 7-8-2024", 50.0)], "doc_id long, text string, confidence double")
    assert sorted((r["doc_id"], r["field"], r["value"], r["confidence"]) for r in header.scored_fields(rows).collect()) == [
        (1, "currency", "USD", 95.0), (1, "invoice_date", "2024-01-29", 50.0), (1, "po_number", "invoice", 50.0),
        (1, "total_amount", "2.50", 60.0), (1, "vendor_name", "NOVA & CO", 60.0),
        (2, "currency", "USD", 95.0), (2, "vendor_name", "É9ÉÀÎÔ x", 50.0), (3, "currency", "USD", 95.0),
    ]
