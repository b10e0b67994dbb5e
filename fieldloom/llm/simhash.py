"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints
differ in at most four bits, one segment differs in at most one bit, so both
have an equal variant of that segment in which the one bit is deleted
(a wildcard). Each distinct fingerprint is indexed under its 64 variants, an
equality join meets candidates, and the join condition verifies the distance
and keeps each pair at one variant alone, so no pair is met twice.

Cases: a null or blank text has fingerprint zero and links like any other;
fewer than four words make one shingle; repeated rows and exact copies share
a fingerprint and cost nothing in the join; a null doc_id keeps its row with
its component's id; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 4
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[i:j], 42) for i, j in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())),
        np.uint64,
        len(words) - size + 1,
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        set_in = np.bincount(octets[:, k], minlength=256) @ _BITS
        for bit in np.flatnonzero(set_in * 2 > len(hashes)):
            out |= 1 << (8 * k + int(bit))
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, hashed: bool = False) -> DataFrame:
    """(doc_id, fp), or (doc_id, text_hash, fp): fp is the fingerprint as a
    signed long, text_hash the xxhash64 of the text."""
    keys = ["doc_id", "text_hash"] if hashed else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fps.view(np.int64))], [*keys, "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return own.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "fp"]))


def _segment(fp: Column, first: int, length: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1))


def _variants(fp: Column) -> Column:
    """Keys (place of the deleted bit in the high byte, segment without it)."""
    keys = []
    for first, length in SEGMENTS:
        for bit in range(first, first + length):
            rest = (1 << length) - 1 - (1 << (bit - first))
            keys.append(_segment(fp, first, length).bitwiseAND(F.lit(rest)).bitwiseOR(F.lit(bit << 32)))
    return F.array(*keys)


def _only_at(key: Column, diff: Column) -> Column:
    """Whether this variant is the one at which a pair with bits ``diff`` counts:
    the first segment with at most one bit, at that bit or else its first one."""
    place = F.shiftright(key, 32)
    out = F.lit(None)
    for first, length in reversed(SEGMENTS):
        part = _segment(diff, first, length)
        at = F.when(part == 0, F.lit(first)).otherwise(
            F.lit(first) + F.bit_count(part - 1)
        )
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return place == out


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, a < b, that differ in at most
    ``distance`` (up to four) bits, each once. ``fps`` has a column fp."""
    if not 0 <= distance <= 4:
        raise ValueError("three one-wildcard segments find up to four differing bits")
    index = fps.select("fp").distinct().select("fp", F.explode(_variants(F.col("fp"))).alias("key"))
    left, right = index.select("key", F.col("fp").alias("a")), index.select("key", F.col("fp").alias("b"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    # an index is sized as if each fingerprint had one variant, so it would be taken for a small table to broadcast
    met = left.join(right.hint("merge"), "key").where(
        (F.col("a") < F.col("b")) & (F.bit_count(diff) <= distance) & _only_at(F.col("key"), diff)
    )
    return met.select("a", "b")


def _components(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, first_id, component) of each fingerprint."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = common.components(links(classes, distance))
    return classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("component")
    )


def representatives(docs: DataFrame, distance: int = 4, text: str = "text") -> DataFrame:
    """(doc_id, text_hash), one row of each component: the smallest doc_id, and
    of its texts in the component the one with the smallest xxhash64. Rows that share a
    doc_id but are no near copies are in components of their own."""
    fps = common.cut(fingerprints(docs, text, hashed=True))
    firsts = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    named = _components(fps, distance).join(firsts, "fp")
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")


def near_duplicates(docs: DataFrame, distance: int = 4, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (the
    smallest doc_id that links of at most ``distance`` bits reach)."""
    fps = common.cut(fingerprints(docs, text))
    named = _components(fps, distance)
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(lowest, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
