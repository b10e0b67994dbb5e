"""Audit of how filters interact, by truth-table survival words.

Five filters fail a document or not. A document's survival word has a bit for
each of the 32 subsets of filters, set if the document passes every filter of
that subset. The positional popcount of the words of a part of the corpus,
one count for each bit, says how many of its documents each subset leaves; it
is taken with carry-save adders, which add three words of one weight to one
word of that weight and one of twice it, for all bits at once. Removed, kept,
redundant and unique counts of every order of filters, and their sums over all
orders, are differences of these 32 counts.

Texts are read once, to a table of a few bytes a document in the shared
folder. Equal texts meet by a 128-bit digest: the smallest doc_id of each is a
minimum that is combined before the shuffle, and an equality join, whose hot
side can be split, brings it back. Words are counted within Arrow batches, and
only counts leave them.

Cases: a null text is an empty one; a null source is the empty part; an empty
text has no words, so it fails A alone (and E as a copy); rows that repeat
count each, and rows that share the smallest doc_id of a text are no copies of
one another; a null doc_id is neither smaller nor larger than any other, so
its row never fails E and has no label; of several labels of one doc_id any
that is 1 counts; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

FILTERS = "ABCDE"
#: The documents of a class are those with this label.
CLASSES = ("every", "good", "toxic")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_TRAIL = bytes(range(0x80, 0xC0))
_SPECIAL = re.compile(rb"[#$%&*|]")


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text, as UTF-8, fails."""
    words = raw.split()  # of bytes: at U+0020 and U+0009 to U+000D
    n = len(words)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _TRAIL))
    tests = (n < 200, 100 * len(set(words)) < 50 * n, 100 * upper > 2 * points, _SPECIAL.search(raw) is not None)
    return sum(1 << k for k, failed in enumerate(tests) if failed)


def survival_word(fails: int, filters: int = len(FILTERS)) -> int:
    """Bit s is set if the subset s of the filters lets a document with these failures pass."""
    return sum(1 << s for s in range(1 << filters) if not s & fails)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    counts = np.zeros(32, np.int64)
    lane, weight = words.astype(np.uint32), 1
    places = np.arange(32, dtype=np.uint32)
    while len(lane):
        carries = []
        while len(lane) >= 3:
            third = len(lane) // 3
            a, b, c = lane[:third], lane[third : 2 * third], lane[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            lane = np.concatenate((half ^ c, lane[3 * third :]))
        counts += weight * ((lane[:, None] >> places) & 1).sum(axis=0, dtype=np.int64)
        lane, weight = np.concatenate(carries) if carries else lane[:0], 2 * weight
    return counts


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, fails, digest) of every row: failures of A to D and a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fails, digests = [], []
            for t in b.column("text"):
                raw = t.as_buffer().to_pybytes()
                fails.append(failures(raw))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())],
                ["doc_id", "part", "fails", "digest"],
            )

    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return own.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``kind``: 1 for a good document, 2 for a toxic one, 3 for both."""
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    kinds = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((has("quality") + 2 * has("toxic")).alias("kind"))
    return rows.join(kinds, "doc_id", "left").withColumn("kind", F.coalesce("kind", F.lit(0)))


def survival_words(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, part, kind, word) of every row; word is the survival word as an int."""
    rows = common.cut(features(docs, text))
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int")
    words = [int(np.uint32(survival_word(m)).view(np.int32)) for m in range(1 << len(FILTERS))]
    fails = F.col("fails") + copy * (1 << FILTERS.index("E"))
    return _labelled(rows.join(firsts, "digest", "left"), labels).select(
        "doc_id", "part", "kind", F.element_at(F.array(*map(F.lit, words)), fails + 1).alias("word")
    )


def survivors(words: DataFrame) -> DataFrame:
    """(part, every, good, toxic): of each class of documents, an array of how many each subset leaves."""
    bits = [f"s{k}" for k in range(1 << len(FILTERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column("part").dictionary_encode()
            code = parts.indices.to_numpy() * 4 + b.column("kind").to_numpy()
            order = np.argsort(code, kind="stable")
            word = b.column("word").to_numpy().view(np.uint32)[order]
            keys, starts = np.unique(code[order], return_index=True)
            counts = np.array([positional_popcount(w) for w in np.split(word, starts[1:])])
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary.take(pa.array(keys // 4)), pa.array(keys % 4, pa.int32()), *map(pa.array, counts.T)], ["part", "kind", *bits]
            )

    counted = words.select("part", "kind", "word").mapInArrow(run, "part string, kind int, " + ", ".join(f"{b} long" for b in bits))
    member = {"every": F.lit(True), "good": F.col("kind").isin(1, 3), "toxic": F.col("kind").isin(2, 3)}
    sums = {c: [F.sum(F.when(member[c], F.col(b)).otherwise(0)) for b in bits] for c in CLASSES}
    return counted.groupBy("part").agg(*[F.array(*sums[c]).alias(c) for c in CLASSES])


def _orders() -> str:
    """Every order and step: the filter and the subsets before and after it, as JSON."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "f": f, "before": before, "after": after})
            before = after
    return json.dumps(out)


def audit(survived: DataFrame) -> DataFrame:
    """Counts of every part, order of filters and step, from the survivors of each subset."""
    size = len(FILTERS)
    left = lambda c, s: F.element_at(F.col(c), (F.lit(s) if isinstance(s, int) else s) + 1)

    def shapley(f: int) -> Column:
        parts = [s for s in range(1 << size) if not s >> f & 1]
        gain = [factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * (left("every", s) - left("every", s | 1 << f)) for s in parts]
        return sum(gain[1:], gain[0])

    step = F.explode(F.from_json(F.lit(_orders()), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"))
    rows = survived.withColumn("shapley_of", F.array(*map(shapley, range(size)))).select("*", step.alias("o")).select("*", "o.*")
    bit = F.element_at(F.array(*[F.lit(1 << f) for f in range(size)]), F.col("f") + 1)
    lost = lambda c: left(c, F.col("before")) - left(c, F.col("after"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        left("every", F.col("after")).alias("kept"),
        lost("every").alias("removed"),
        (left("every", 0) - left("every", bit) - lost("every")).alias("redundant"),
        (left("every", F.lit((1 << size) - 1) - bit) - left("every", (1 << size) - 1)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("shapley_of", F.col("f") + 1).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The audit of all documents, one row for each part, order and step."""
    return audit(survivors(survival_words(docs, labels, text)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), l AS (
  SELECT doc_id, max((quality = 1) :: INT) AS good, max((toxic = 1) :: INT) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o
), c AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f, fails, n, good, toxic,
         translate(substr(filter_order, 1, step - 1), fails, '') = substr(filter_order, 1, step - 1) AS alive,
         contains(fails, substr(filter_order, step, 1)) AS hit
  FROM g, s
), r AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (alive AND NOT hit), 0) :: BIGINT AS kept,
         coalesce(sum(n) FILTER (alive AND hit), 0) :: BIGINT AS removed,
         coalesce(sum(n) FILTER (NOT alive AND hit), 0) :: BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0) :: BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (alive AND hit), 0) :: BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (alive AND hit), 0) :: BIGINT AS toxic_lost
  FROM c GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f) :: BIGINT AS shapley
FROM r
"""
