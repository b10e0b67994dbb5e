"""Streams over files, run until all that has arrived is done."""

from fieldloom.operators import consensus
from fieldloom.plans import render
from fieldloom.streaming import live


def test_votes_resolve_once(spark, folder, tmp_path):
    votes = render.votes(spark, folder)
    votes.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        live.resolved_to(live.arriving(spark, str(tmp_path / "in"), votes.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert got.count() == consensus.field_vote(votes).count()


def test_vendor_state(spark, tmp_path):
    spark.sql("SELECT 1L doc_id, 'Acme Inc' vendor_name, 50D confidence, TIMESTAMP '2024-01-01' seen_at UNION ALL SELECT 2L, 'ACME', 70D, TIMESTAMP '2024-01-02' UNION ALL SELECT 3L, 'acme', 70D, TIMESTAMP '2024-01-03'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.vendor_states(live.arriving(spark, str(tmp_path / "in"), "doc_id long, vendor_name string, confidence double, seen_at timestamp"))
    q = stream.writeStream.format("memory").queryName("vendor_rows").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    row = spark.sql("SELECT * FROM vendor_rows").first()
    assert (row["vendor_name"], row["invoice_count"]) == ("ACME", 3)


def test_admission(spark, tmp_path):
    spark.sql("SELECT 'a.pdf' path, 10L size UNION ALL SELECT 'b.exe', 10L").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live.admitted(live.arriving(spark, str(tmp_path / "in"), "path string, size long")).writeStream.format("memory").queryName("uploads").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["path"]: r["status"] for r in spark.sql("SELECT * FROM uploads").collect()} == {"a.pdf": "PROCESSING", "b.exe": "FAILED"}
