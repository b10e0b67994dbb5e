"""Tables as sinks and files dealt by kind: repeated, killed and mixed writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import routing, sinks
from fieldloom.streaming import live


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upserts(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda data, schema: spark.createDataFrame(data, schema)
    assert sinks.current(spark, path) is None
    assert sinks.created(spark, path, "id long, name string") and not sinks.created(spark, path, "id long")
    sinks.upsert(make([(1, "a"), (2, "b"), (1, "c"), (None, "n")], "id long, name string"), path, ["id"], ["name"], batch=0)
    assert rows(sinks.current(spark, path)) == rows(make([(1, "c"), (2, "b"), (None, "n")], "id long, name string"))
    # a new column; null replaces, and a column that the batch lacks stays
    sinks.upsert(make([(2, None, 5), (3, "d", 6)], "id long, name string, score int"), path, ["id"], batch=1)
    after = [(1, "c", None), (2, None, 5), (3, "d", 6), (None, "n", None)]
    assert rows(sinks.current(spark, path)) == sorted(after, key=str)
    assert not sinks.upsert(make([(9, "x")], "id long, name string"), path, ["id"], batch=1)  # applied before
    sinks.upsert(make([(3, 7)], "id long, score int"), path, ["id"])
    assert (3, "d", 7) in rows(sinks.current(spark, path))
    sinks.insert(make([(3, "no"), (4, "yes"), (4, "yes"), (None, "no")], "id long, name string"), path, ["id"])
    for _ in range(2):
        sinks.insert(make([(4, "again")], "id long, name string"), path, ["id"])
    assert {r["id"]: r["name"] for r in sinks.current(spark, path).collect()} == {1: "c", 2: None, 3: "d", 4: "yes", None: "n"}
    assert sinks.repeated(sinks.current(spark, path), ["id"]).count() == 0
    assert sinks.versions(spark, path)[-1][1] == 1 and len(sinks.versions(spark, path)) == 2


def test_killed_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.range(3).withColumn("n", F.lit(1)), path, ["id"], batch=0)
    broken = spark.range(9).withColumn("n", F.expr("CASE WHEN id < 8 THEN 2 ELSE raise_error('killed') END"))
    with pytest.raises(Exception, match="killed"):
        sinks.upsert(broken, path, ["id"], batch=1)
    (tmp_path / "t" / "_staged-left").mkdir()
    assert rows(sinks.current(spark, path)) == [(0, 1), (1, 1), (2, 1)]
    assert sinks.upsert(spark.range(1).withColumn("n", F.lit(3)), path, ["id"], batch=1)
    assert rows(sinks.current(spark, path)) == [(0, 3), (1, 1), (2, 1)]
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_staged")]


def test_references(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 10)], "id int, parent int")
    parents = spark.createDataFrame([(10,), (10,), (None,)], "key int")
    assert rows(sinks.detached(children, "parent", parents, "key")) == rows(spark.createDataFrame([(1, 10), (2, None), (3, None), (4, 10)], "id int, parent int"))


FILES = {
    "a.csv": b'x,"1,5"\n\n"two\nlines",\n', "bad.csv": b'a,"b\n', "latin.csv": b"\xe9,1", "n/one.json": '{"a": 1, "b": {"c": [1]}, "é": null}'.encode(),
    "many.jsonl": b'{"k": "1"}\n{"k": "2"}\n', "bad.json": b'{"a": ', "list.json": b"[1, 2]", "t.txt": b"\xef\xbb\xbfhello", "p.pdf": b"%PDF-1.7 x", "fake.pdf": b"hello",
    "i.PNG": b"\x89PNG\r\n\x1a\nrest", "empty.txt": b"", "what.exe": b"MZ", "noending": b"x",
}
FAILED = {"bad.csv": "bad_csv", "latin.csv": "not_utf8", "bad.json": "bad_json", "list.json": "bad_json", "fake.pdf": "bad_signature", "empty.txt": "empty", "what.exe": "unknown_kind", "noending": "unknown_kind"}


def test_routed_files(spark, tmp_path):
    def put(names):
        for name in names:
            at = tmp_path / "in" / name
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(FILES[name])

    put(list(FILES)[:6])
    with (tmp_path / "in" / "huge.txt").open("wb") as f:
        f.truncate(11 * 1024 * 1024)
    run = lambda: routing.arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    put(list(FILES)[6:])
    run()
    run()
    found = routing.tables(spark, str(tmp_path / "out"))
    name = F.element_at(F.split("path", "/"), -1)
    assert sorted(r[0] for r in found["files"].select(name).collect()) == sorted([*(n.split("/")[-1] for n in FILES), "huge.txt"])
    assert {r[0]: r[1] for r in found["failed"].select(name, "reason").collect()} == FAILED | {"huge.txt": "too_large"}
    assert rows(found["csv"].select("row", "col", "value")) == [(0, 0, "x"), (0, 1, "1,5"), (1, 0, "two\nlines"), (1, 1, "")]
    assert sorted((r[0], r["record_no"], tuple(sorted(r["record"].items(), key=str))) for r in found["json"].select(name, "record_no", "record").collect()) == [
        ("many.jsonl", 0, (("k", "1"),)), ("many.jsonl", 1, (("k", "2"),)), ("one.json", 0, (("a", "1"), ("b", '{"c": [1]}'), ("é", None))),
    ]
    assert [r["text"] for r in found["text"].collect()] == ["hello"]
    assert found["binary"].count() == 2
    routing.dealt(routing.routed(routing.files_of(spark, str(tmp_path / "in"))), str(tmp_path / "whole"))
    assert routing.tables(spark, str(tmp_path / "whole"))["files"].count() == len(FILES) + 1


def test_vendor_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schema = "doc_id long, vendor_name string, confidence double, seen_at timestamp"
    (tmp_path / "in").mkdir()
    for k, data in enumerate([[(1, "Acme Inc", 50.0, at), (2, "ACME", 70.0, at)], [(3, "acme", 70.0, at), (4, None, 90.0, at), (5, "Borg", 20.0, at)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):
            live.vendors_to(live.arriving(spark, str(tmp_path / "in"), schema), str(tmp_path / "v"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["vendor_name"], r["invoice_count"]) for r in sinks.current(spark, str(tmp_path / "v")).collect()) == [("ACME", 3), ("Borg", 1)]
