"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern (an
item of fewer words is one). For patterns of m words a shift table over blocks
of two words says how far the search may jump; where the jump is zero the
block's bucket, refined by the first word, names the patterns to compare
directly. Patterns of another length have tables of their own.

The benchmark's distinct items, long ones in overlapping pieces, go to the
tasks in blocks of about ``BLOCK_CHARS`` of text. A benchmark of one block is
searched in one pass without a shuffle. Of several, one at a time is collected,
searched over all documents and its hits are written to the shared folder, by
doc_id and hash of the text, so neither the driver nor a task holds more than a
block, and rows meet their hits by values that a lost executor cannot change.

Cases: null or wordless text has no words and is never contaminated; a null or
wordless item has no window; items with a null item_id mark words but are not
listed; repeated rows of either table are independent; empty tables give an
empty result, or no hit; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldloom.llm import common

WINDOW = 10
BLOCK_CHARS = 1_000_000
#: ASCII letters and digits, and every byte of other characters.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words(text: str | None) -> list[bytes]:
    return _WORDS(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Searcher:
    """Wu-Manber search for patterns of ``m`` words each."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(2, m)
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(self.block, m + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets[pattern[m - self.block :]][pattern[0]].append((pattern, items))

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(start of an occurrence, items of its pattern)."""
        m, block, far = self.m, self.block, self.m - self.block + 1
        shift, at, n = self.shift.get, self.m - 1, len(text)
        while at < n:
            key = (text[at - 1], text[at]) if block == 2 else (text[at],)
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for pattern, items in self.buckets[key].get(text[start], ()):
                if all(text[start + i] == w for i, w in enumerate(pattern)):
                    yield start, items
            at += 1


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        if w := words(text):
            m = min(window, len(w))
            for i in range(len(w) - m + 1):
                by_length[m][tuple(w[i : i + m])].add(item_id)
    return [Searcher(m, patterns) for m, patterns in sorted(by_length.items())]


def hits(text: list[bytes], searchers: list[Searcher]) -> tuple[bytearray, set]:
    """A flag for each word, and the items whose windows occur."""
    hit, found = bytearray(len(text)), set()
    for s in searchers:
        for start, items in s.search(text):
            hit[start : start + s.m] = b"\x01" * s.m
            found |= items
    found.discard(None)
    return hit, found


_LAST: dict[str, list[Searcher]] = {}


def _searchers(key: str, items: list, window: int) -> list[Searcher]:
    """Tables of a block, kept until the worker needs another block's."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = build(items, window)
    return _LAST[key]


#: Words by which a long item's pieces advance.
PIECE_WORDS = 20_000
_SPARK_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, text) of distinct items; a long one in pieces that share a window's words but one."""
    words_of = F.regexp_extract_all("text", F.lit(_SPARK_WORD), F.lit(0))
    items = benchmark.select("item_id", "text").where("text is not null").select("item_id", words_of.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS))
    piece = F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)), " ")
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", piece.alias("text")).distinct()


def _blocks(pieces: DataFrame, chars: int) -> tuple[int, Callable[[int], list[tuple]]]:
    """The number of blocks, and what gives one of them."""
    total = pieces.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return n, lambda i: [tuple(r) for r in pieces.where(block == i).collect()]


def _searched(rows: DataFrame, items: list, window: int, item_type: T.DataType) -> DataFrame:
    """``rows`` (with a column text) with n_words, hit (word numbers) and items in its place."""
    key, arrow_type = uuid.uuid4().hex, pa.list_(to_arrow_type(item_type))
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _searchers(key, items, window)
        for b in batches:
            n_words, hit, listed = [], [], []
            for text in b.column("text"):
                own, found = hits(words(text.as_py()), tables)
                n_words.append(len(own))
                hit.append([i for i, x in enumerate(own) if x])
                listed.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*map(b.column, kept), pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(listed, arrow_type)],
                [*kept, "n_words", "hit", "items"],
            )

    more = [T.StructField("n_words", T.LongType()), T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(item_type))]
    return rows.mapInArrow(run, T.StructType([*rows.select(*kept).schema, *more]))


def _hits_by_text(docs: DataFrame, n: int, block, window: int, item_type: T.DataType) -> DataFrame:
    """(doc_id, text_hash, hit, items) of the texts with hits, over ``n`` blocks."""
    spark = docs.sparkSession
    path = common.scratch_path(spark, "benchmark-hits")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    for i in range(n):
        found = _searched(rows, block(i), window, item_type).drop("n_words").where(F.size("hit") > 0)
        found.write.mode("append").parquet(path)
    return (
        spark.read.parquet(path)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.array_distinct(F.flatten(F.collect_set("hit"))).alias("hit"),
            F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        )
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated and items (the item_ids)."""
    item_type = benchmark.schema["item_id"].dataType
    pieces = _pieces(benchmark, window)
    n, block = _blocks(pieces, block_chars)
    if n == 1:
        found = _searched(docs.select("doc_id", "text"), block(0), window, item_type)
    else:
        marked = _hits_by_text(docs, n, block, window, item_type).withColumnRenamed("doc_id", "hit_id").withColumnRenamed("text_hash", "hit_hash")
        counted = _searched(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), [], window, item_type)
        rows = counted.select("doc_id", "text_hash", "n_words")
        same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
        none = lambda c: F.coalesce(c, F.array().cast(marked.schema[c].dataType))
        found = rows.join(marked, same, "left").select("doc_id", "n_words", none("hit").alias("hit"), none("items").alias("items"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
        "items",
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of ``docs``, whole, in which no window occurs."""
    pieces = _pieces(benchmark, window)
    n, block = _blocks(pieces, block_chars)
    if n > 1:
        marked = _hits_by_text(docs, n, block, window, benchmark.schema["item_id"].dataType)
        hit_id, hit_hash = common.unused("id", "hash")
        marked = marked.select(F.col("doc_id").alias(hit_id), F.col("text_hash").alias(hit_hash))
        same = F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_hash))
        return docs.join(marked, same, "left_anti")
    items, key, place = block(0), uuid.uuid4().hex, docs.columns.index("text")
    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Spark refuses names with dots here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _searchers(key, items, window)
        for b in batches:
            yield b.filter(pa.array([not any(hits(words(t.as_py()), tables)[0]) for t in b.column(place)], pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pat AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), occ AS (
  SELECT r, i, m, item_id
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m) g
  JOIN pat USING (m) WHERE array_to_string(w[i : i + m - 1], ' ') = gram
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM occ) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item_id :: VARCHAR, ',' ORDER BY item_id :: VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r
)
SELECT doc_id, len(w) :: BIGINT AS n_words, coalesce(n_hit, 0) :: BIGINT AS n_hit,
       coalesce(n_items, 0) :: BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
