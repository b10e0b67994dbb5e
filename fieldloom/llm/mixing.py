"""Mixing sources to target weights by systematic sampling, in DataFrame operations.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all
words of the table. A target stops at ``cap`` times its source's size; what it
leaves is shared again by weight until no target is above. Within a source
every document expects target / source size copies: the prefix sum of these
expected copies, plus one random offset, crosses an integer boundary once for
every copy that the mix takes.

The prefix sum runs in the order (size class, salt, size, doc_id), so that
documents of like size are sampled evenly and a source's taken words stay
close to its target. Rows are ranked inside cells (source, size class, salt),
which split a hot source or a hot size over many tasks; cells add the counts
of the cells before them, and there are at most a fixed number of cells to a
source.

Cases: null or blank text has size 0 and nothing is taken of it but empty
copies, which change no count of words; a source of size 0 has target 0; rows
of one doc_id and size are ranked in one cell, by the hashes of their text and
of their other columns, so that which text is taken never depends on how rows
lie; a null doc_id sorts first, its salt is the length of its text; an empty
table gives an empty result. The columns that ``mix`` adds replace input
columns of the same name, ``sample`` keeps them; columns used inside have names
that no input has.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

SALTS = 251
#: Weights of the sources, in order and repeating.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Columns that a mix adds.
ADDED = ("size", "source_size", "target", "copies", "taken")
#: Seed of the offset; no value is better than another.
SEED = 0


def offset(seed: int = SEED) -> float:
    """The one random offset of a mix: a reproducible draw from [0, 1)."""
    return random.Random(seed).random()


def size_class(size: Column) -> Column:
    """Bit length of the size and the three bits after its leading one."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).cast("int") % 8


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    everything = Window.partitionBy()
    return (
        sources.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("held", F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything))
        .select(
            "source",
            "source_size",
            F.least(F.col("limit").cast("double"), F.coalesce(F.col("held") * F.col("weight"), F.lit(0.0))).alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` (doc_id, source, text and others) with size, source_size,
    target, copies and taken (copies times size)."""
    null, source, level, salt, hashed, n, size, before, place, each = common.unused(
        "null", "source", "class", "salt", "hash", "n", "words", "before", "place", "each"
    )
    rows = docs.drop(*ADDED)
    whole = [c for c, kind in zip(common.quoted(rows.columns), rows.dtypes) if not any(x in kind[1] for x in ("map<", "variant"))]
    named = rows.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long"))
    keyed = named.withColumns(
        {
            source: F.coalesce("source", F.lit("")),
            null: F.col("source").isNull(),
            level: size_class(F.col("size")),
            salt: F.pmod(F.coalesce(F.col("doc_id"), F.length(text), F.lit(0)), F.lit(SALTS)).cast("int"),
            hashed: F.struct(F.xxhash64(text), F.xxhash64(*whole)),
        }
    )
    cell = [null, source, level, salt]
    cells = common.cut(keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias(n), F.sum("size").alias(size)))
    sources = cells.groupBy(null, source).agg(F.sum(size).alias("source_size"))
    shares = targets(sources.select(F.when(~F.col(null), F.col(source)).alias("source"), "source_size"), weights, cap).select(
        F.col("source").isNull().alias(null), F.coalesce("source", F.lit("")).alias(source), "source_size", "target"
    )
    ahead = Window.partitionBy(null, source).orderBy(level, salt)
    starts = cells.withColumn(before, F.coalesce(F.sum(n).over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(shares, [null, source]).drop(n, size)
    ranked = F.col(before) + F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc_id", hashed))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = lambda k: F.floor(k.cast("double") * F.col(each) + F.lit(offset(seed)))
    return (
        keyed.join(starts, cell)
        .withColumns({place: ranked, each: share})
        .withColumn("copies", (crossed(F.col(place)) - crossed(F.col(place) - 1)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(*cell, hashed, before, place, each)
    )


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a mix, each as many times as it has copies."""
    (copy,) = common.unused("copy")
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(*common.quoted(columns), again.alias(copy)).drop(copy)


def sample(
    docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED
) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with
    all their columns, those included whose names :func:`mix` uses."""
    own = {c: common.unused(c)[0] for c in docs.columns if c.lower() in ADDED}
    renamed = docs.withColumnsRenamed(own)
    emitted = emit(mix(renamed, text, weights, cap, seed), renamed.columns)
    return emitted.withColumnsRenamed({new: old for old, new in own.items()})


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id, length(text), 0) AS salt,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) :: BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size) :: BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap :: DOUBLE / weight, source NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) :: DOUBLE
           / (sum(weight) OVER (ORDER BY cap :: DOUBLE / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) :: DOUBLE AS level
  FROM f
), t AS (
  SELECT source, source_size, least(cap :: DOUBLE, coalesce(
           max(CASE WHEN level <= cap :: DOUBLE / weight THEN level END) OVER () * weight, 0)) AS target
  FROM l
), p AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY
           length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8,
           (salt % {SALTS} + {SALTS}) % {SALTS}, size, doc_id NULLS FIRST) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(place * each + {offset()!r}) - floor((place - 1) * each + {offset()!r})) :: BIGINT * size AS taken
FROM p
"""
