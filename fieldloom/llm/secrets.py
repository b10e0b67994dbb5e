"""Secret scans in DataFrame operations: patterns, and sliding-window entropy.

Base spans are the leftmost non-overlapping matches of three patterns. Beyond
them, candidate strings (long runs of one character class) are searched with a
sliding window. The counts of the window's characters are the state: the
character that leaves takes one from its count, the one that enters adds one
to its own, and the entropy changes by these two counts alone, so a candidate
takes time in proportion to its length. A candidate whose best window reaches
the threshold of its class is a span of its own, unless the allow-list knows
its form or a base span overlaps it.

Positions come from the lengths of the pieces between matches, summed in blocks
and then over blocks, so everything is an expression over the row: no shuffle,
no Python.

Cases: a null text is an empty one; empty texts have no span; spans are in code
points, end exclusive; equal starts are ordered by kind; repeated rows are
scanned alike; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Patterns that give just the matches of the least length: a run that is long enough is found whole, and no part of a shorter one is.
LONG = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: A cheap test that every text with a match of at least the least length passes.
HINTS = {
    "assign": r"""(?i)(?:passw|secret|token|api_?key)""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Entropy kinds: character class, its pattern, and the least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Za-z+/_-])[0-9A-Fa-f]{24,}(?![0-9A-Za-z+/_-])", 3.2),
    ("entropy_base64", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[0-9A-Za-z+/_-]{24,}={0,2}", 3.9),
)
#: Forms that are no secrets.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    r"(?i)example|sample|placeholder|dummy|changeme|xxxx",
    r"^(?!.*//)/[A-Za-z0-9_/-]+$",  # path
    r"^(.)\1+$",
)
WINDOW = 20
#: Matches whose places are summed up together.
BLOCK = 256
#: The characters of candidates lie between these, so a window's counts are an array.
FIRST, LAST = "+", "z"
#: Entropies are summed in whole steps of this size, so that no error builds up.
STEP = 2.0**-40


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, match>> of the matches of a pattern.

    Starts are summed within blocks of matches and then over the blocks, as an
    array that grows by one match a step would be copied for every match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.filter(F.arrays_zip(between.alias("piece"), found.alias("match")), lambda x: x["match"].isNotNull())
    empty = F.array().cast("array<struct<start:int,match:string>>")

    def within(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + F.length(x["piece"])).alias("start"), x["match"].alias("match"))).alias("out"),
            ),
        )

    def blocks(every: Column) -> Column:
        last = F.floor((F.size(every) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: within(F.slice(every, k * BLOCK + 1, F.lit(BLOCK))))

    def moved(parts: Column) -> Column:
        ahead = F.aggregate(
            parts,
            F.array(F.lit(0)),
            lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]),
        )
        both = F.arrays_zip(parts.alias("part"), F.slice(ahead, F.lit(1), F.size(parts)).alias("ahead"))
        return F.flatten(
            F.transform(
                both,
                lambda b: F.transform(
                    b["part"]["out"], lambda x: F.struct((x["start"] + b["ahead"]).alias("start"), x["match"].alias("match"))
                ),
            )
        )

    # each level is bound to a name of its own, so that none is computed again
    return _bound(both, lambda every: F.when(F.size(every) > 0, _bound(blocks(every), moved)).otherwise(empty))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, kind: str, order: int, pattern: str, keep) -> Column:
    kept = F.filter(_placed(text, pattern), lambda x: keep(x["match"]))
    return F.transform(
        kept,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(order).alias("order"),
            (x["start"] + F.length(x["match"])).alias("end"),
            F.lit(kind).alias("kind"),
        ),
    )


_NONE = "array<struct<start:int,order:int,end:int,kind:string>>"


def base_spans(text: Column, kind: str) -> Column:
    order = [k for k, *_ in BASE].index(kind)
    _, pattern, group, least = BASE[order]
    pattern = LONG.get(kind, pattern)
    counted = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    found = _spans(text, kind, order, pattern, lambda m: F.length(counted(m)) >= least)
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(_NONE))


def _moves(codes: Column, width: int) -> Column:
    """The characters that enter the window and, with a minus, that leave it, in order."""
    at = F.sequence(F.lit(width + 1), F.size(codes))
    pairs = F.transform(at, lambda i: F.array(-F.element_at(codes, i - width), F.element_at(codes, i)))
    return F.concat(
        F.slice(codes, 1, width), F.when(F.size(codes) > width, F.flatten(pairs)).otherwise(F.array().cast("array<int>"))
    )


def best_entropy(candidate: Column, width: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits) of the windows of a candidate of ``width`` characters or more.

    With f(c) = c log2 c, the entropy is log2(width) - sum f(count) / width;
    a character that enters or leaves changes the sum by its own count alone."""
    table = F.array(*[F.lit(round(c * math.log2(c) / STEP) if c else 0).cast("long") for c in range(width + 2)])
    f = lambda c: F.element_at(table, c + 1)
    places = ord(LAST) - ord(FIRST) + 1
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c) - F.lit(ord(FIRST) - 1))
    start = F.struct(
        F.array_repeat(F.lit(0), places).alias("counts"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("now"), F.lit(2**62).alias("least")
    )

    def step(acc: Column, move: Column) -> Column:
        place, by = F.abs(move), F.when(move > 0, 1).otherwise(-1)
        old = F.element_at(acc["counts"], place)
        counts = F.concat(F.slice(acc["counts"], F.lit(1), place - 1), F.array(old + by), F.slice(acc["counts"], place + 1, F.lit(places)))
        now = acc["now"] + f(old + by) - f(old)
        full = acc["size"] + by == width
        return F.struct(
            counts.alias("counts"),
            (acc["size"] + by).alias("size"),
            now.alias("now"),
            F.when(full, F.least(acc["least"], now)).otherwise(acc["least"]).alias("least"),
        )

    least = _bound(codes, lambda c: F.aggregate(_moves(c, width), start, step, lambda acc: acc["least"]))
    return F.lit(math.log2(width)) - least * STEP / width


def entropy_spans(text: Column) -> Column:
    """Candidates of each class with a window of high entropy, but for allowed forms."""
    parts = []
    for k, (kind, pattern, least) in enumerate(CLASSES):
        def secret(m: Column, least: float = least) -> Column:
            known = F.lit(False)
            for allowed in ALLOWED:
                known = known | m.rlike(allowed)
            return ~known & (best_entropy(m) >= least)

        parts.append(
            F.when(text.rlike(pattern), _spans(text, kind, len(BASE) + k, pattern, secret)).otherwise(F.array().cast(_NONE))
        )
    return F.concat(*parts)


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and spans."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = [k for k, *_ in BASE]
    rows = rows.withColumns({f"_{k}": base_spans(F.col("_text"), k) for k in kinds} | {"_entropy": entropy_spans(F.col("_text"))})
    base = F.concat(*[F.col(f"_{k}") for k in kinds])
    rows = rows.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in kinds],
        base.alias("_base"),
        F.filter(
            "_entropy", lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        ).alias("_more"),
    )
    return rows.select(
        "doc_id",
        *[f"n_{k}" for k in kinds],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_more")).alias("spans"),
    )
