"""The states of documents as they move, with deadlines, in keyed state with event-time timers.

Events (doc_id, status, at) move a document along the allowed moves; any other move is
refused and leaves it where it is. A document that has been waiting since its last move for
longer than its state allows, with no event by the watermark, is FAILED by a timer.

Cases: within a batch a document's events are taken by time, then by their place in the
order of states; an event older than the document's last accepted one is refused as late, a
repeated one changes nothing and is reported as a repeat, so replays and restarts give the
same states; null ids, states or times never reach the state and are reported by
:func:`unreadable`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: States in their order, what each may become, and how long one may wait.
STATES = ("UPLOADED", "PROCESSING", "EXTRACTED", "CORRECTED", "APPROVED", "FAILED")
MOVES = {
    None: ("UPLOADED", "PROCESSING"),
    "UPLOADED": ("PROCESSING", "FAILED"),
    "PROCESSING": ("EXTRACTED", "FAILED"),
    "EXTRACTED": ("CORRECTED", "APPROVED", "PROCESSING"),
    "CORRECTED": ("CORRECTED", "APPROVED", "PROCESSING"),
    "APPROVED": ("CORRECTED",),
    "FAILED": ("PROCESSING",),
}
DEADLINES = {"UPLOADED": dt.timedelta(seconds=300), "PROCESSING": dt.timedelta(seconds=300)}

# times are microseconds, which no time zone touches
_STATE = StructType([StructField("status", StringType()), StructField("at", LongType()), StructField("moves", LongType())])
_MOVED = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("status", StringType()),
        StructField("at", LongType()),
        StructField("moves", LongType()),
        StructField("asked", StringType()),
        StructField("refused", StringType()),
    ]
)


def moved(status: str | None, since: int | None, asked: str, at: int) -> str | None:
    """Why a document in a state since a time may not move; null if it may."""
    if since is not None and (at, asked) == (since, status):
        return "repeat"
    if since is not None and at < since:
        return "late"
    if asked not in MOVES.get(status, ()):
        return f"illegal: {status or 'NEW'} to {asked}"
    return None


class _Machine(StatefulProcessor):
    def __init__(self, deadlines: dict[str, dt.timedelta]) -> None:
        self.deadlines = {s: d // dt.timedelta(microseconds=1) for s, d in deadlines.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("document", _STATE)

    def _now(self) -> tuple[str | None, int | None, int]:
        return tuple(self.state.get()) if self.state.exists() else (None, None, 0)

    def _watch(self, status: str, at: int) -> None:
        """The one timer of a document: its deadline in this state."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status in self.deadlines:
            self.handle.registerTimer((at + self.deadlines[status]) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        status, since, moves = self._now()
        began = (status, since)
        order = lambda e: (e["at"], STATES.index(e["status"]) if e["status"] in STATES else len(STATES), e["status"])
        for event in sorted(rows, key=order):
            refused = moved(status, since, event["status"], event["at"])
            if refused is None:
                status, since, moves = event["status"], event["at"], moves + 1
            yield Row(doc_id=key[0], status=status, at=since, moves=moves, asked=event["status"], refused=refused)
        if (status, since) != began:
            self.state.update((status, since, moves))
            self._watch(status, since)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        status, since, moves = self._now()
        if status in self.deadlines:
            at = since + self.deadlines[status]
            self.state.update(("FAILED", at, moves + 1))
            yield Row(doc_id=key[0], status="FAILED", at=at, moves=moves + 1, asked="FAILED", refused=None)

    def close(self) -> None:
        pass


def _readable() -> F.Column:
    return F.col("doc_id").isNotNull() & F.col("status").isNotNull() & F.col("at").isNotNull()


def unreadable(events: DataFrame) -> DataFrame:
    """Events without an id, a state or a time."""
    return events.where(~_readable())


def states(events: DataFrame, lateness: str = "1 minute", deadlines: dict[str, dt.timedelta] = DEADLINES) -> DataFrame:
    """A stream of events (doc_id, status, at) as a stream of what became of each: the
    document's state after it and why it was refused, and the moves that timers make.

    Needs the RocksDB state store; see :func:`configured`."""
    timed = events.where(_readable()).select("doc_id", "status", F.col("at").alias("time")).withWatermark("time", lateness)
    own = timed.withColumn("at", F.unix_micros("time"))
    rows = own.groupBy("doc_id").transformWithState(_Machine(deadlines), _MOVED, "Update", "EventTime")
    return rows.withColumn("at", F.timestamp_micros("at"))


def configured(spark) -> None:
    """Lets a session keep state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(rows: DataFrame) -> DataFrame:
    """(doc_id, status, at): the last accepted state of each document of collected rows."""
    last = F.max_by(F.struct("status", "at"), "moves")
    return rows.where("refused is null").groupBy("doc_id").agg(last.alias("s")).select("doc_id", "s.status", "s.at")
