"""Conversation repair against a search over whole edit sequences and roles."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import rows as columns
from pyspark.sql import functions as F

from fieldloom.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string"
NO_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) for c, r in out.items()}


def brute(rows):
    """The result of one damaged conversation, by uniform-cost search over (cost, edits)."""
    seen, faults = set(), []
    for _, role, text in rows:
        letters = NO_SPACE.findall(text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, edits, i, out = heapq.heappop(heap)
        initials = "".join(role[:1] or "?" for role, _ in out)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            break
        if (i, initials[-2:], len(initials), edits) in done or not re.match("(s?(ua)*u?)?$", initials):
            continue
        done.add((i, initials[-2:], len(initials), edits))
        if not edits.endswith("III"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, edits + "I", i, (*out, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + more, edits + "K", i + 1, (*out, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, (*out, (other, text))))
    whole = "\n".join(f"{r}:{t}" for r, t in out)
    count = faults.count
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, edits, hashlib.sha256(whole.encode()).hexdigest()), out


def some(n, seed):
    r = random.Random(seed)
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "What?", "cut", "", " \t", None, "é.", "x. \n"]
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 6)):
            rows.append((c, None if r.random() < 0.1 else t + r.choice([0, 0, 0, 2]), roles[t % 2] if r.random() < 0.6 else r.choice(roles), r.choice(texts)))
    return [*rows, (None, 1, "user", "a."), (None, 1, "assistant", "b"), (None, None, None, None), (-3, 2, "user", "Hi."), (-3, 2, "user", "Hi.")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "true AS dropped", "7 AS fault", "map(1, 2) AS part", "'k' AS audit", "1 AS _time")


@pytest.mark.parametrize("block", [64, 2])
def test_against_search(spark, monkeypatch, block):
    rows = some(150, block)
    monkeypatch.setattr(convrepair, "BLOCK", block)
    source = convrepair.damage(frame(spark, rows))
    want = damaged(rows)
    if block == 64:
        results = convrepair.repair(source)
        got = {r[0]: tuple(r[1:]) for r in results.collect()}
        left = defaultdict(list)
        for r in convrepair.repaired(source, results).orderBy("conv_id", "place").collect():
            left[r["conv_id"]].append((r["role"], r["text"]))
        for c, rows in want.items():
            assert got[c] == brute(rows)[0], (c, rows)
            assert tuple(left[c]) == brute(rows)[1]
        assert got.keys() == want.keys()
        import duckdb

        duck = duckdb.connect()
        conversations = spark.createDataFrame(some(150, block), SCHEMA).toPandas().astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
        twin = duck.sql(convrepair.ORACLE).df()
        assert columns(twin) == columns(results.toPandas())
    else:  # several blocks to a conversation
        for c, rows in want.items():
            seen, one = set(), convrepair.Conversation(c)
            for turn, role, text in rows:
                last = (NO_SPACE.findall(text) or [""])[-1]
                fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
                seen.add((role, text))
                one.add(turn, role, text, fault)
            assert one.result() == (c, *brute(rows)[0])


def test_long_conversation(spark, monkeypatch):
    """The blocks of a long conversation give what one block of all its rows does."""
    rows = [(1, t, "user" if t % 3 else "assistant", f"{t}." if t % 7 else f"{t}") for t in range(3000)]
    got = convrepair.repair(convrepair.damage(spark.createDataFrame(rows, SCHEMA))).first()
    monkeypatch.setattr(convrepair, "BLOCK", 10_000)
    whole = convrepair.Conversation(1)
    seen = set()
    for turn, role, text in damaged(rows)[1]:
        whole.add(turn, role, text, 1 if not text else 2 if (role, text) in seen else 0 if text[-1] == "." else 3)
        seen.add((role, text))
    assert whole.result() == tuple(got)


def test_empty(spark):
    assert convrepair.repair(convrepair.damage(frame(spark, []))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = convrepair.repair(convrepair.damage(frame(spark, [(gone, 0, "user", "a.")]))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    one = convrepair.repair(convrepair.damage(frame(spark, [(1, 0, "user", "a.")])).withColumn("conv_id", F.col("conv_id").cast("string")))
    assert one.first()["conv_id"] == "1"
