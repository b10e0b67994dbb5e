"""Voting on field values: agreement, winner, confidence, and merges.

Votes are long rows (doc_id, voter, voter_ord, field, value, confidence). They
are dealt once by document; the aggregations by field and by document run on
that partitioning, and keys are told apart within a field's row. A document's votes are as many as its voters and
fields, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import dates, money, text
from fieldloom.functions.text import first_case, let, simple_key, vote_key

# Weights of voters in ties, and factors of the calibration.
WEIGHTS = {
    "docling": 1.2, "impira": 1.0, "layoutlm": 1.1, "donut": 1.0,
    "ocr_rapid": 0.7, "ocr_docling": 0.7, "ocr_tesseract": 0.6, "ocr_fused": 1.2,
}
PREFERRED = "docling"
VOTER_FACTOR = {"docling": 1.1, "impira": 1.0, "layoutlm": 1.05, "donut": 0.95}
FIELD_FACTOR = {"invoice_number": 1.1, "invoice_date": 1.0, "total_amount": 0.9, "vendor_name": 0.95, "due_date": 1.0, "currency": 1.05}
BOOST = {"unanimous": 1.15, "strong": 1.1, "moderate": 1.0, "weak": 0.9, "conflict": 0.8}
AGREEMENT_FACTOR = {"unanimous": 1.1, "strong": 1.05, "moderate": 1.0, "weak": 0.9, "conflict": 0.75}
#: By what votes are dealt.
DOCUMENT, KEY = ["doc_id"], ["doc_id", "field"]


def looked_up(key: Column, values: dict[str, float], default: float = 1.0) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def agreement(n: Column, most: Column) -> Column:
    """Level of agreement of ``n`` voters of whom ``most`` agree."""
    return first_case(
        [
            ((n >= 4) & (most == 4), F.lit("unanimous")),
            ((n >= 4) & (most == 3), F.lit("strong")),
            ((n >= 4) & (most == 2), F.lit("moderate")),
            (n >= 4, F.lit("conflict")),
            ((n == 3) & (most == 3), F.lit("unanimous")),
            ((n == 3) & (most == 2), F.lit("strong")),
            (n == 3, F.lit("weak")),
            ((n == 2) & (most == 2), F.lit("unanimous")),
            (n == 2, F.lit("conflict")),
            (n == 1, F.lit("weak")),
        ],
        F.lit("none"),
    )


def _sum(values: Column) -> Column:
    """The sum of those that are not null, null if there are none."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda total, x: F.coalesce(total + x, total, x))


def _ranked(votes: Column, key: Column) -> Column:
    """What a key's votes are ranked by; the least is the winner: most votes, the preferred voter's, greatest weight, first seen."""
    own = F.filter(votes, lambda v: v["key"] == key)
    rank = lambda o: F.struct(
        (-F.size(o)).alias("votes"), (~F.array_contains(o["preferred"], True)).alias("other"), (-F.round(_sum(o["weight"]), 6)).alias("weighted"),
        F.array_min(o["voter_ord"]).alias("first_ord"), key.alias("key"),
    )
    return let(own, rank)


def field_vote(votes: DataFrame, dealt: list[str] | None = DOCUMENT) -> DataFrame:
    """doc_id, field, value (the winning key), confidence, agreement,
    vote_counts, all_values, selected_from and original (the first spelling).

    The votes of a field, as many as its voters, meet in one row by one aggregation; keys are told apart inside it.
    Votes are dealt by ``dealt``; None leaves them where they lie, as where their documents were dealt before they voted."""
    weight, preferred = F.col("confidence") * looked_up(F.col("voter"), WEIGHTS), (F.col("voter") == PREFERRED) & F.col("voter_ord").isNotNull()
    vote = F.struct("voter_ord", "voter", "value", "key", "confidence", weight.alias("weight"), F.coalesce(preferred, F.lit(False)).alias("preferred"))
    # one shuffle serves the aggregation, and what is grouped by document, or joined by the whole key, after it
    lying = votes if dealt is None else votes.repartition(*dealt)
    fields = lying.withColumn("key", vote_key(F.col("value"))).groupBy("doc_id", "field").agg(F.sort_array(F.collect_list(vote)).alias("votes"))
    best = (
        fields.withColumn("ranks", F.transform(F.array_distinct("votes.key"), lambda key: _ranked(F.col("votes"), key)))
        .select("doc_id", "field", "votes", "ranks", F.array_min("ranks").alias("best"))
        .select(
            "doc_id",
            "field",
            F.col("best.key").alias("key"),
            F.filter("votes", lambda v: v["key"] == F.col("best.key")).alias("by"),
            F.sort_array(F.transform("ranks", lambda r: F.struct(r["first_ord"].alias("first_ord"), r["key"].alias("key"), (-r["votes"]).alias("votes")))).alias("tally"),
            agreement(F.size("votes"), -F.col("best.votes")).alias("agreement"),
        )
        .withColumn("mean_confidence", _sum(F.col("by.confidence")) / F.size(F.array_compact(F.col("by.confidence"))))
    )
    voter = F.element_at("by", 1)["voter"]
    raw = F.least(F.lit(99.0), F.col("mean_confidence") * looked_up(F.col("agreement"), BOOST))
    calibrated = (
        raw
        * looked_up(voter, VOTER_FACTOR)
        * looked_up(F.col("field"), FIELD_FACTOR)
        * looked_up(F.col("agreement"), AGREEMENT_FACTOR)
    )
    return best.select(
        "doc_id",
        "field",
        F.col("key").alias("value"),
        F.round(F.greatest(F.lit(10.0), F.least(F.lit(99.0), calibrated)), 1).alias("confidence"),
        "agreement",
        F.map_from_entries(F.transform("tally", lambda t: F.struct(t["key"], t["votes"]))).alias("vote_counts"),
        F.col("tally.key").alias("all_values"),
        F.col("by.voter").alias("selected_from"),
        F.element_at("by", 1)["value"].alias("original"),
    )


def merged(resolved: DataFrame) -> DataFrame:
    """doc_id, fields (map), overall_confidence, needs_review (fields that are weak or in conflict)."""
    return resolved.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"),
        # confidences have one decimal, so their mean rounds exactly, halves up
        (F.floor(F.sum(F.round(F.col("confidence") * 10).cast("long")) * 10 / F.count(F.lit(1)) + 0.5) / 100).alias("overall_confidence"),
        F.array_sort(F.collect_list(F.when(F.col("agreement").isin("weak", "conflict"), F.col("field")))).alias("needs_review"),
    )


def agreement_statistics(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("agreement").agg(
        F.count(F.lit(1)).alias("fields"), F.round(F.avg("confidence"), 2).alias("average_confidence")
    )


def voter_contribution(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.explode("selected_from").alias("voter")).groupBy("voter").agg(F.count(F.lit(1)).alias("fields"))


def conflicts(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("agreement").isin("weak", "conflict")).select("doc_id", "field", "agreement", "value", "confidence")


def three_way(votes: DataFrame) -> DataFrame:
    """The first value that two voters share, with its best confidence, else the most confident one."""
    whole = Window.partitionBy("doc_id", "field")
    return (
        votes.where("value is not null and value <> ''")
        .withColumn("key", simple_key(F.col("value")))
        .withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "field", "key")))
        .withColumn("agreed", F.max((F.col("same") >= 2).cast("int")).over(whole) == 1)
        .withColumn("group_ord", F.min("voter_ord").over(Window.partitionBy("doc_id", "field", "key")))
        .withColumn(
            "place",
            F.row_number().over(
                whole.orderBy(
                    (F.col("same") >= 2).desc(),
                    F.when(F.col("same") >= 2, F.col("group_ord")),
                    F.col("confidence").desc(),
                    "voter_ord",
                )
            ),
        )
        .where("place = 1")
        .select("doc_id", "field", "value", "confidence", F.col("agreed").alias("consensus"))
    )


def two_way(votes: DataFrame, first: str, second: str, prefer_first: tuple[str, ...]) -> DataFrame:
    """Two voters side by side: 98 if they agree, else the preferred one's confidence times 0.9."""
    of = lambda voter: F.max(F.when(F.col("voter") == voter, F.struct("value", "confidence")))
    both = (
        votes.where(F.col("voter").isin(first, second))
        .groupBy("doc_id", "field")
        .agg(of(first).alias("one"), of(second).alias("two"))
        .select(
            "doc_id", "field", F.col("one.value").alias("a"), F.col("one.confidence").alias("a_confidence"),
            F.col("two.value").alias("b"), F.col("two.confidence").alias("b_confidence"),
        )
    )
    equal = simple_key(F.col("a")) == simple_key(F.col("b"))
    a_wins = F.col("field").isin(*prefer_first)
    return both.select(
        "doc_id",
        "field",
        first_case(
            [(F.col("b").isNull(), F.col("a")), (F.col("a").isNull(), F.col("b")), (equal | a_wins, F.col("a"))], F.col("b")
        ).alias("value"),
        F.round(
            first_case(
                [
                    (F.col("b").isNull(), F.col("a_confidence")),
                    (F.col("a").isNull(), F.col("b_confidence")),
                    (equal, F.lit(98.0)),
                    (a_wins, F.col("a_confidence") * 0.9),
                ],
                F.col("b_confidence") * 0.9,
            ),
            2,
        ).alias("confidence"),
    )


# Confidences that registered voters vote with unless they bring their own.
REGISTERED = {"ocr_text": 75.0, "ocr_fused": 82.0, "ocr_template": 85.0}


def registered(readings: DataFrame, voter: str, order: int) -> DataFrame:
    """Readings (doc_id, field, value, and confidence or null) as votes of a voter beside the models."""
    default = REGISTERED.get(voter, REGISTERED["ocr_text"])
    return readings.select(
        "doc_id", F.lit(voter).alias("voter"), F.lit(order).alias("voter_ord"), "field", "value", F.coalesce("confidence", F.lit(default)).alias("confidence")
    )


def n_way(votes: DataFrame, forced: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every voted or forced field once: a forced value (doc_id, field, value, confidence)
    before a fused reading that overrides (doc_id, field, value) before the vote.

    The three inputs are one row a (doc_id, field) by the same key, so the joins reuse the
    vote's partitioning. Null and empty forced values force nothing.
    """
    given = forced.where("value is not null and value <> ''").select("doc_id", "field", F.col("value").alias("_forced"), F.col("confidence").alias("_confidence"))
    fused = overrides.select("doc_id", "field", F.col("value").alias("_fused"))
    both = field_vote(votes, KEY).join(given, KEY, "full").join(fused, KEY, "left")
    is_forced, is_fused = F.col("_forced").isNotNull(), F.col("_fused").isNotNull()
    pick = lambda a, b, c: first_case([(is_forced, a), (is_fused, b)], c)
    return both.select(
        "doc_id",
        "field",
        pick(F.col("_forced"), F.col("_fused"), F.col("value")).alias("value"),
        pick(F.col("_confidence"), F.lit(REGISTERED["ocr_fused"]), F.col("confidence")).alias("confidence"),
        pick(F.lit("forced_template"), F.lit("fused_override"), F.col("agreement")).alias("agreement"),
        pick(F.array(F.lit("ocr_template")), F.array(F.lit("ocr_fused")), F.col("selected_from")).alias("selected_from"),
    )


def field_cleaned(fields: DataFrame) -> DataFrame:
    """Merged fields (doc_id, field, value) cleaned by name; fields whose names begin with _ are internal and go."""
    cleaned = first_case(
        [
            (F.col("field") == "total_amount", money.symbols_dropped(F.col("value"))),
            (F.col("field") == "invoice_date", dates.simple(F.col("value"))),
            (F.col("field") == "invoice_number", text.number_simple(F.col("value"))),
            (F.col("field") == "currency", text.currency_clean(F.col("value"))),
            (F.col("field") == "vendor_name", F.trim("value")),
        ],
        F.col("value"),
    )
    return fields.where(~F.col("field").startswith("_")).withColumn("value", cleaned)


# A record merged from three models votes once for each, with the confidence of one of its fields.
FANNED = (("impira", 1, "invoice_number"), ("layoutlm", 2, "total_amount"), ("donut", 3, "vendor_name"))


def fanned_out(merged_fields: DataFrame, default: float = 85.0) -> DataFrame:
    """Merged fields (doc_id, field, value, confidence) as the votes of three models."""
    of = lambda field: F.coalesce(F.max(F.when(F.col("field") == field, F.col("confidence"))), F.lit(default))
    voters = F.array(*[F.struct(F.lit(v).alias("voter"), F.lit(o).alias("voter_ord"), of(f).alias("confidence")) for v, o, f in FANNED])
    by_doc = merged_fields.groupBy("doc_id").agg(voters.alias("voters"), F.collect_list(F.struct("field", "value")).alias("fields"))
    each = by_doc.select("doc_id", F.explode("voters").alias("v"), "fields")
    return each.select("doc_id", "v.*", F.explode("fields").alias("f")).select("doc_id", "voter", "voter_ord", "f.field", "f.value", "confidence")


def with_failures(documents: DataFrame, records: DataFrame) -> DataFrame:
    """Documents (doc_id) with their records (doc_id, fields, overall_confidence), or a
    record of failure where no voter ran: no fields, confidence 0 and an error."""
    kept = records.select("doc_id", "fields", "overall_confidence", F.lit(True).alias("_ran"))
    ran = F.coalesce("_ran", F.lit(False))
    return documents.select("doc_id").join(kept, "doc_id", "left").select(
        "doc_id",
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
        F.coalesce("overall_confidence", F.lit(0.0)).alias("overall_confidence"),
        F.when(ran, "EXTRACTED").otherwise("FAILED").alias("status"),
        F.when(~ran, "no voter ran").alias("error"),
    )


def items_kept(first: DataFrame, second: DataFrame) -> DataFrame:
    """Line items of ``first``, and those of ``second`` for documents that ``first`` has none of."""
    return first.unionByName(second.join(first.select("doc_id").distinct(), "doc_id", "left_anti"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Fields (doc_id, field, value) of two runs side by side, with what became of each."""
    old, new = (df.select("doc_id", "field", F.col("value").alias(n)) for df, n in ((before, "before"), (after, "after")))
    change = first_case(
        [(F.col("before").isNull() & F.col("after").isNull(), F.lit("same")), (F.col("before").isNull(), F.lit("added")), (F.col("after").isNull(), F.lit("lost")), (F.col("before") == F.col("after"), F.lit("same"))],
        F.lit("changed"),
    )
    return old.join(new, ["doc_id", "field"], "full").withColumn("change", change)


def scored(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Of each field of expected values (doc_id, field, value): how many, how many were read right, and the share in percent."""
    pairs = expected.select("doc_id", "field", F.col("value").alias("want")).join(found.select("doc_id", "field", "value"), ["doc_id", "field"], "left")
    right = F.sum(text.same_reading(F.col("value"), F.col("want")).cast("int"))
    return pairs.groupBy("field").agg(F.count(F.lit(1)).alias("expected"), right.alias("right"), F.round(right * 100 / F.count(F.lit(1)), 2).alias("accuracy"))
