"""States with deadlines and refreshed templates, over restarts."""

import datetime as dt

import pytest

from fieldloom.streaming import live, status, templated

EVENT = "doc_id long, status string, at timestamp"
VOTE = "doc_id long, vendor_id long, arrived_at timestamp, voter string, voter_ord int, field string, value string, confidence double"
CORRECTION = "id long, vendor_id long, field_name string, corrected_value string, bbox array<double>, page_number int, created_at timestamp"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


FILES = [
    [(1, "UPLOADED", 0), (1, "PROCESSING", 5), (2, "UPLOADED", 1), (3, "EXTRACTED", 2), (4, "PROCESSING", 3), (5, "UPLOADED", 4)],
    [(1, "EXTRACTED", 30), (1, "PROCESSING", 5), (2, "APPROVED", 40), (4, "UPLOADED", 1), (None, "UPLOADED", 3), (5, "PROCESSING", 50)],
    [(6, "UPLOADED", 1000), (1, "APPROVED", 1001)],
    [(7, "UPLOADED", 2000), (1, "CORRECTED", 2001), (2, "PROCESSING", 2002)],
    [(8, "UPLOADED", 2500)],
]
WANT = {
    1: ("CORRECTED", at(2001)), 2: ("FAILED", at(2302)), 4: ("FAILED", at(303)), 5: ("FAILED", at(350)),
    6: ("FAILED", at(1300)), 7: ("FAILED", at(2300)), 8: ("UPLOADED", at(2500)),
}


@pytest.mark.parametrize("restarts", [False, True])
def test_states(spark, tmp_path, restarts):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    status.configured(spark)
    out, arrived = str(tmp_path / "out"), tmp_path / "in"
    arrived.mkdir()

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run():
        events = live.arriving(spark, str(arrived), EVENT, per_trigger=1)
        status.states(events).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    try:
        for k, rows in enumerate(FILES):
            spark.createDataFrame([(d, s, at(t)) for d, s, t in rows], EVENT).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
            (part,) = (tmp_path / f"f{k}").glob("*.parquet")
            part.rename(arrived / f"{k}.parquet")
            if restarts:
                run()
        run()
    finally:
        spark.conf.set(provider, before)
    rows = spark.read.parquet(out)
    assert {r["doc_id"]: (r["status"], r["at"]) for r in status.latest(rows).collect()} == WANT
    refused = {(r["doc_id"], r["asked"], r["refused"]) for r in rows.where("refused is not null").collect()}
    assert refused == {(3, "EXTRACTED", "illegal: NEW to EXTRACTED"), (1, "PROCESSING", "repeat"), (2, "APPROVED", "illegal: UPLOADED to APPROVED"), (4, "UPLOADED", "late")}


def test_moves():
    assert status.moved("PROCESSING", at(5), "PROCESSING", at(5)) == "repeat"
    assert status.moved("PROCESSING", at(5), "EXTRACTED", at(4)) == "late"
    assert status.moved(None, None, "UPLOADED", at(0)) is None
    assert set(status.MOVES) - {None} == set(status.STATES) and all(x in status.STATES for v in status.MOVES.values() for x in v)


def test_templates_follow_corrections(spark, tmp_path):
    arrived, held = tmp_path / "in", tmp_path / "corrections"
    arrived.mkdir()
    spark.createDataFrame([], CORRECTION).write.parquet(str(held))

    def arrive(k, docs):
        rows = [(d, v, at(t), voter, n, "currency", value, c) for d, v, t in docs for n, (voter, value, c) in enumerate([("impira", "USD", 60.0), ("donut", "EUR", 55.0)])]
        spark.createDataFrame(rows, VOTE).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
        (part,) = (tmp_path / f"f{k}").glob("*.parquet")
        part.rename(arrived / f"{k}.parquet")

    def correct(i, vendor, value, t):
        spark.createDataFrame([(i, vendor, "currency", value, [0.0, 0.0, 1.0, 1.0], 1, at(t))], CORRECTION).write.mode("append").parquet(str(held))

    def run():
        stream = live.arriving(spark, str(arrived), VOTE, per_trigger=1)
        templated.resolved_with_templates(stream, str(held), CORRECTION, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out"))
        return {r["doc_id"]: (r["value"], r["template_applied"]) for r in rows.collect()}

    arrive(0, [(1, 7, 10), (2, None, 10)])
    assert run() == {1: ("usd", False), 2: ("usd", False)}
    correct(1, 7, "EUR", 20)
    correct(2, 7, "GBP", 900)  # after the next batch's documents: not seen by it
    arrive(1, [(3, 7, 30), (4, 8, 30), (5, None, 30)])
    after = {1: ("usd", False), 2: ("usd", False), 3: ("eur", True), 4: ("usd", False), 5: ("usd", False)}
    assert run() == after == run()  # each run starts anew from its checkpoint
    first = spark.read.schema(VOTE).parquet(str(arrived / "1.parquet"))
    again = templated.records(first, spark.read.schema(CORRECTION).parquet(str(held)))
    assert {r["doc_id"]: (r["value"], r["template_applied"]) for r in again.collect()} == {k: after[k] for k in (3, 4, 5)}
    assert templated.records(first, spark.read.schema(CORRECTION).parquet(str(held)), least=2).where("template_applied").count() == 0
