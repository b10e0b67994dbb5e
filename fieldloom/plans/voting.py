"""Queries of the consensus operators over votes rendered from ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import consensus
from fieldloom.plans import render
from fieldloom.plans.sql import TALLY, VOTES


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.field_vote(render.votes(spark, folder, dealt=True), None)


def field_vote(spark: SparkSession, folder: str) -> DataFrame:
    out = _resolved(spark, folder)
    return out.select(
        "doc_id",
        "field",
        "value",
        "original",
        "confidence",
        "agreement",
        F.array_join(F.transform("all_values", lambda v: F.concat(v, F.lit("="), F.element_at("vote_counts", v).cast("string"))), ";").alias("tally"),
        F.array_join("selected_from", ",").alias("selected_from"),
    )


def vote_tie_break(spark: SparkSession, folder: str) -> DataFrame:
    """Fields whose best values tie, and what decides."""
    counts = F.map_values("vote_counts")
    ties = F.size(F.filter(counts, lambda c: c == F.array_max(counts)))
    return _resolved(spark, folder).where(ties > 1).select(
        "doc_id", "field", "value", F.when(F.array_contains("selected_from", consensus.PREFERRED), "preferred").otherwise("weight").alias("decided_by")
    )


def merge_overall_confidence(spark: SparkSession, folder: str) -> DataFrame:
    out = consensus.merged(_resolved(spark, folder))
    return out.select("doc_id", "overall_confidence", F.array_join("needs_review", ",").alias("needs_review"), F.size("fields").alias("n_fields"))


def three_way_merge(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.three_way(render.votes(spark, folder).where("voter_ord < 3"))


def two_way_merge(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.two_way(render.votes(spark, folder), "layoutlm", "donut", ("invoice_number", "total_amount"))


def merger_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.agreement_statistics(_resolved(spark, folder))


def voter_contribution(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.voter_contribution(_resolved(spark, folder))


def conflict_report(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.conflicts(_resolved(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (field_vote, vote_tie_break, merge_overall_confidence, three_way_merge, two_way_merge, merger_statistics, voter_contribution, conflict_report)
}

ORACLES = {
    "field_vote": f"WITH {TALLY} SELECT doc_id, field, value, original, confidence, agreement, tally, array_to_string(voters, ',') AS selected_from FROM resolved",
    "vote_tie_break": f"""WITH {TALLY}, tied AS (SELECT doc_id, field FROM ranked WHERE votes = most GROUP BY ALL HAVING count(*) > 1)
      SELECT doc_id, field, value, CASE WHEN list_contains(voters, 'docling') THEN 'preferred' ELSE 'weight' END AS decided_by
      FROM resolved JOIN tied USING (doc_id, field)""",
    "merge_overall_confidence": f"""WITH {TALLY} SELECT doc_id, floor(sum(round(confidence * 10) :: BIGINT) * 10 :: DOUBLE / count(*) + 0.5) / 100 AS overall_confidence,
      coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE agreement IN ('weak', 'conflict')), '') AS needs_review, count(*) :: INT AS n_fields
      FROM resolved GROUP BY doc_id""",
    "three_way_merge": f"""WITH {VOTES}, v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, field, lower(trim(value))) AS same,
        min(voter_ord) OVER (PARTITION BY doc_id, field, lower(trim(value))) AS g FROM votes WHERE voter_ord < 3 AND value <> ''),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY (same >= 2) DESC, CASE WHEN same >= 2 THEN g END NULLS FIRST, confidence DESC, voter_ord) AS place FROM v)
      SELECT doc_id, field, value, confidence, same >= 2 AS consensus FROM r WHERE place = 1""",
    "two_way_merge": f"""WITH {VOTES}, m AS (SELECT doc_id, field, max(value) FILTER (WHERE voter = 'layoutlm') AS a, max(confidence) FILTER (WHERE voter = 'layoutlm') AS ca,
        max(value) FILTER (WHERE voter = 'donut') AS b, max(confidence) FILTER (WHERE voter = 'donut') AS cb FROM votes WHERE voter IN ('layoutlm', 'donut') GROUP BY doc_id, field)
      SELECT doc_id, field, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN lower(trim(a)) = lower(trim(b)) OR field IN ('invoice_number', 'total_amount') THEN a ELSE b END AS value,
        round(CASE WHEN b IS NULL THEN ca WHEN a IS NULL THEN cb WHEN lower(trim(a)) = lower(trim(b)) THEN 98.0 :: DOUBLE
             WHEN field IN ('invoice_number', 'total_amount') THEN ca * 0.9 :: DOUBLE ELSE cb * 0.9 :: DOUBLE END, 2) AS confidence FROM m""",
    "merger_statistics": f"WITH {TALLY} SELECT agreement, count(*) AS fields, round(avg(confidence), 2) AS average_confidence FROM resolved GROUP BY agreement",
    "voter_contribution": f"WITH {TALLY} SELECT voter, count(*) AS fields FROM (SELECT unnest(voters) AS voter FROM resolved) GROUP BY voter",
    "conflict_report": f"WITH {TALLY} SELECT doc_id, field, agreement, value, confidence FROM resolved WHERE agreement IN ('weak', 'conflict')",
}
