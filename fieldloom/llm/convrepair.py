"""Repair of conversation structure at least cost, decided by integer minima.

A conversation's rows are edited so that its roles read: nothing, or a system
row or none and then user and assistant rows in turn, ending with an
assistant. Keep costs nothing, Rerole to user or assistant 1, Delete 2
(blank and repeated rows must go), Insert of an empty user or assistant row 5,
and a truncated row that stays 5 more. Among the cheapest edits the initials
in order that are least as ASCII decide.

Edits are paths through a graph of (rows read, last role). A path weighs one
integer: its high digits are the cost, its low digits, of fixed width and
placed from the left, are the letters of its edits (D 1, I 2, K 3, R 4), with
zeros where a path has ended. A smaller integer is a cheaper path or, at one
cost, the ASCII-smaller one, so the minimum of sums decides everything. All
paths that have read as many rows end with the letter of the last row, so none
begins another, and the best path to each of the four roles is enough.

Rows go to tasks by conversation, sorted there by Spark, and are read as a
stream, ``BLOCK`` rows at a time. Between blocks the letters of the at most
four paths give way to their rank, a digit in the integers of the next block,
and each path carries the running hash of the rows that it repairs, so a
conversation of any length takes the memory of a block and its audit. A hash
over all its rows in order is one pass, and so one conversation is one task;
all tests of rows run before or beside that pass as expressions.

Cases: a null role or text, or in the damage key a null conv_id or turn, is
one space; rows of one turn (null turns first) are ordered by role, then text;
rows with a null conv_id are one conversation; a role counts by its first
character, and one that is not s, u or a, or that is empty, must be re-roled
or deleted; repeated rows are faults by the rule and not merged; a conversation
without rows has zeros, an empty audit and the hash of an empty text; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: White space of texts.
SPACE = " \t\n\x0b\x0c\r"
#: Rows whose letters are digits of one integer.
BLOCK = 64
#: Letters of edits in ASCII order from 1, costs.
LETTERS = " DIKR"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Last roles: none yet, system, user, assistant; the role that an inserted or re-roled row must take after each.
NEXT = (2, 2, 3, 2)
#: The last role after a kept row of an initial.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
ENDS = (0, 3)
NAMES = ("", "system", "user", "assistant")
NONE, BLANK, DUPLICATE, CUT = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (which stays, marked, so that its conversation does), 1 empties
    its text, 2 removes its end marks, 3 repeats it, 4 sets its role to user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(word("role")).alias("role"),
        text.alias("text"),
        (kind == 0).alias("dropped"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("times"),
    ).select("conv_id", "turn", "role", "text", "dropped", F.explode("times").alias("_time")).drop("_time")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault`` to (conv_id, turn, role, text, dropped): the first fault of each row.

    Rows are dealt by conversation once; the search for repeated rows needs no other exchange."""
    word = lambda c: F.coalesce(c, F.lit(" "))
    own = rows.select("conv_id", "turn", word(F.col("role")).alias("role"), word(F.col("text")).alias("text"), "dropped").repartition("conv_id")
    alike = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = (
        F.when(last == "", BLANK).when(F.row_number().over(alike) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    )
    return own.withColumn("fault", fault)


def _code(role: str, fault: int) -> str:
    """One character for all that the search needs of a row: the capital of its
    initial if it is truncated, d if it must go."""
    if fault in (BLANK, DUPLICATE):
        return "d"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == CUT else initial


@lru_cache(1 << 16)
def search(entries: tuple[tuple[int, int], ...], codes: str, final: bool) -> list[tuple[int, int, int, str]]:
    """The best paths over a block of rows.

    ``entries``: (last role, cost) of the best paths so far, in the order of
    their letters. Returns (last role, cost, index of the entry, letters) of the
    best path to each role in the order of all letters; if ``final``, of the one
    best path that may end."""
    width = 3 * len(codes) + 2
    ranks, costs = 3 * width, 3 * width + 2  # bits below the rank and below the cost

    def step(value: int, at: int, letters: str, cost: int) -> tuple[int, int]:
        for letter in letters:
            at += 1
            value += LETTERS.index(letter) << 3 * (width - at)
        return value + (cost << costs), at

    def gap(q: int) -> Iterator[tuple[str, int, int]]:
        yield "", q, 0
        yield "I", NEXT[q], INSERT
        yield "II", NEXT[NEXT[q]], 2 * INSERT

    paths = {q: ((cost << costs) + (k << ranks), 0) for k, (q, cost) in enumerate(entries)}
    for code in codes:
        found: dict[int, tuple[int, int]] = {}
        initial, more = code.lower(), TRUNCATED if code.isupper() else 0
        for q, (value, at) in paths.items():
            for inserted, m, cost in gap(q):
                moves = [("D", m, DELETE)]
                if initial != "d":
                    moves.append(("R", NEXT[m], REROLE + more))
                    if (initial, m) in KEPT:
                        moves.append(("K", KEPT[initial, m], KEEP + more))
                for letter, to, extra in moves:
                    path = step(value, at, inserted + letter, cost + extra)
                    if to not in found or path < found[to]:
                        found[to] = path
        paths = found
    if final:
        ended = [(step(value, at, inserted, cost), m) for q, (value, at) in paths.items() for inserted, m, cost in gap(q) if m in ENDS]
        path, m = min(ended)
        paths = {m: path}
    low = (1 << costs) - 1
    out = []
    for q, (value, at) in sorted(paths.items(), key=lambda x: x[1][0] & low):
        letters = "".join(LETTERS[value >> 3 * (width - 1 - p) & 7] for p in range(at))
        out.append((q, value >> costs, (value & low) >> ranks, letters))
    return out


def apply(edits: str, rows: list[tuple[str, str]], last: int) -> Iterator[tuple[str, str, str, int]]:
    """The rows (edit, role, text, last role) that edits leave of (role, text) rows, after a last role."""
    at = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        last = KEPT[role[:1], last] if edit == "K" else NEXT[last]
        yield edit, role if edit == "K" else NAMES[last], text, last


class _Path:
    """The best path to a last role: its cost, edits and the hash of the rows it leaves."""

    __slots__ = ("last", "cost", "before", "edits", "hash", "begun")

    def __init__(self) -> None:
        self.last, self.cost, self.before, self.edits, self.hash, self.begun = 0, 0, None, "", hashlib.sha256(), False

    def after(self, last: int, cost: int, edits: str, rows: list[tuple[str, str]]) -> _Path:
        out = _Path()
        out.last, out.cost, out.before, out.edits, out.hash, out.begun = last, cost, self, edits, self.hash.copy(), self.begun
        for _, role, text, _ in apply(edits, rows, self.last):
            out.hash.update(f"{chr(10) * out.begun}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.begun = True
        return out

    def audit(self) -> str:
        parts, path = [], self
        while path is not None:
            parts.append(path.edits)
            path = path.before
        return "".join(reversed(parts))


class Conversation:
    """One conversation as a stream of rows in order."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.counts = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.turn = self.initial = None
        self.rows: list[tuple[str, str]] = []
        self.codes = ""
        self.paths = [_Path()]

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if len(self.codes) == BLOCK:
            self._block(False)
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.rows.append((role, text))
        self.codes += _code(role, fault)

    def _block(self, final: bool) -> None:
        found = search(tuple((p.last, p.cost - self.paths[0].cost) for p in self.paths), self.codes, final)
        base = self.paths[0].cost
        self.paths = [self.paths[k].after(q, base + cost, edits, self.rows) for q, cost, k, edits in found]
        self.rows, self.codes = [], ""

    def result(self) -> tuple:
        self._block(True)
        (path,) = self.paths
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, path.cost, path.audit(), path.hash.hexdigest())


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Within tasks, by conversation and in the order of its rows; ``first`` sorts before the turn."""
    return rows.sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "text"
    )


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, dropped): conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for b in batches:
            ids = b.column("conv_id")
            done = []
            columns = [b.column(c) for c in ("turn", "role", "text", "dropped", "fault")]
            for k in range(b.num_rows):
                conv_id = ids[k].as_py()
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id)
                turn, role, text, dropped, fault = (c[k].as_py() for c in columns)
                if not dropped:
                    now.add(turn, role, text, fault)
            yield _batch(done, ids.type)
        if now is not None:
            yield _batch([now.result()], ids.type)

    def _batch(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * (len(names) + 1)
        types = [of, *[pa.int64()] * (len(names) - 2), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *names])

    return _in_order(faults(rows)).mapInArrow(run, f"conv_id {kind}, {_RESULT}")


def repaired(rows: DataFrame, results: DataFrame) -> DataFrame:
    """The rows that the edits of ``results`` (conv_id, audit) leave of ``rows``:
    (conv_id, place, edit, turn, role, text), place from 1; an inserted row has no turn.

    A conversation's audit is the first row of its stream, so nothing is held but the audit and a batch."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    word = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    audits = results.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("part"))
    own = rows.where("not dropped").select("conv_id", "turn", word("role"), word("text"), F.lit(1).alias("part"))

    names = ["conv_id", "place", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = conv_id = None
        edits, last, place = iter(""), 0, 0

        def replay(turn: int | None, rows: list[tuple[str, str]]) -> Iterator[tuple]:
            """What is left of one row, after what is inserted before it; of no row, the inserted rest."""
            nonlocal last, place
            for edit in edits:
                for _, role, text, last in apply(edit, rows, last):
                    place += 1
                    yield conv_id, place, edit, None if edit == "I" else turn, role, text
                if edit != "I":
                    return

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(names)
            types = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for b in batches:
            of, out = b.column("conv_id").type, []
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("conv_id", "turn", "role", "text", "part")}
                if row["part"] == 0:
                    out += replay(None, [])
                    conv_id, edits, last, place = row["conv_id"], iter(row["text"]), 0, 0
                else:
                    out += replay(row["turn"], [(row["role"], row["text"])])
            yield batch(out)
        if of is not None:
            yield batch(list(replay(None, [])))

    both = _in_order(audits.unionByName(own).repartition("conv_id"), "part")
    return both.mapInArrow(run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id :: VARCHAR, ' ') || ':' || coalesce(turn :: VARCHAR, ' ') AS key
  FROM conversations
), k AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295 :: BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x) :: BIGINT)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [0 :: BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                               lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind
  FROM c
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM k
), f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS behind,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM d
), gap(q, letters, m, price, lines) AS (
  VALUES (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''),
         (0, 'I', 2, 5, E'user:\n'), (1, 'I', 2, 5, E'user:\n'), (2, 'I', 3, 5, E'assistant:\n'), (3, 'I', 2, 5, E'user:\n'),
         (0, 'II', 3, 10, E'user:\nassistant:\n'), (1, 'II', 3, 10, E'user:\nassistant:\n'),
         (2, 'II', 2, 10, E'assistant:\nuser:\n'), (3, 'II', 3, 10, E'user:\nassistant:\n')
), move(m, letter, initial, q2, price, name) AS (
  VALUES (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL),
         (0, 'R', NULL, 2, 1, 'user'), (1, 'R', NULL, 2, 1, 'user'), (3, 'R', NULL, 2, 1, 'user'), (2, 'R', NULL, 3, 1, 'assistant'),
         (0, 'D', NULL, 0, 2, NULL), (1, 'D', NULL, 1, 2, NULL), (2, 'D', NULL, 2, 2, NULL), (3, 'D', NULL, 3, 2, NULL)
), p AS (
  SELECT DISTINCT conv_id, 0 :: BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS out FROM conversations
  UNION ALL
  SELECT conv_id, i, q, cost, audit, out FROM (
    SELECT p.conv_id, f.i, move.q2 AS q, p.audit || gap.letters || move.letter AS audit,
           p.cost + gap.price + move.price + CASE WHEN f.fault = 'truncated' AND move.letter <> 'D' THEN 5 ELSE 0 END AS cost,
           p.out || CASE WHEN move.letter = 'D' THEN gap.lines ELSE gap.lines || coalesce(move.name, f.role) || ':' || f.text || chr(10) END AS out
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
      JOIN gap ON gap.q = p.q
      JOIN move ON move.m = gap.m
    WHERE (move.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND coalesce(move.initial = f.role[1], true)
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1
), e AS (
  SELECT p.conv_id, p.cost + gap.price AS cost, p.audit || gap.letters AS audit, p.out || gap.lines AS out
  FROM p JOIN gap ON gap.q = p.q
  WHERE gap.m IN (0, 3) AND p.i = (SELECT count(*) FROM f WHERE f.conv_id IS NOT DISTINCT FROM p.conv_id)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + gap.price, p.audit || gap.letters) = 1
), n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (behind IS NOT NULL AND behind[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) :: BIGINT AS gaps, coalesce(blank, 0) :: BIGINT AS blank, coalesce(duplicate, 0) :: BIGINT AS duplicate,
       coalesce(truncated, 0) :: BIGINT AS truncated, coalesce(illegal, 0) :: BIGINT AS illegal, cost :: BIGINT AS cost, audit,
       sha256(CASE WHEN out = '' THEN '' ELSE out[:-2] END) AS repaired_sha256
FROM e LEFT JOIN n ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""
