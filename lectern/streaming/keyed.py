"""Keyed state with lists, maps and timers: deletion tokens, a bounded queue of what could not be sent, refreshes now and then.

Each is a processor of Spark's arbitrary state, which needs the RocksDB state store (``with_state_store``), and a batch form by windows over the same events
that gives the same rows. Events of a key are taken in the order of (ts, event_id); those of one micro-batch must not be older than the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TOKEN_LIFE = 300  # seconds
QUEUE = 100
DELAY = "10 minutes"


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _schema(fields: str) -> T.StructType:
    """Of "name kind, ..."; made without a session, as workers have none."""
    kinds = {"string": T.StringType(), "long": T.LongType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def _same(a: str | None, b: str | None) -> bool:
    """Equal; null is not equal to anything."""
    return a is not None and a == b


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def _streamed(events: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str = DELAY) -> DataFrame:
    with_state_store(events.sparkSession)
    return events.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")


# Deletion tokens.

VERDICTS = "token string, event_id long, verdict string"


class Tokens(StatefulProcessor):
    """One value a token: whom and what it was given for, and until when. A timer on event time lets it go."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.proof = handle.getValueState("proof", _schema("teacher string, course string, version string, title string, until long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in _in_order(rows).itertuples():
            at = int(r.ts.timestamp() * 1000)
            proof = self.proof.get() if self.proof.exists() else None
            if r.action == "prepare":
                if proof:
                    self.handle.deleteTimer(proof[4])
                self.proof.update((r.teacher, r.course, r.version, r.title, at + 1000 * TOKEN_LIFE))
                self.handle.registerTimer(at + 1000 * TOKEN_LIFE)
                continue
            if proof is None or at >= proof[4]:
                verdict = "expired"
            elif not (_same(r.teacher, proof[0]) and _same(r.course, proof[1])):
                verdict = "other"
            else:
                verdict = "changed" if not _same(r.version, proof[2]) else "deleted" if _same(r.title, proof[3]) else "title"
            if verdict in ("changed", "deleted"):
                self.handle.deleteTimer(proof[4])
                self.proof.clear()
            out.append((key[0], r.event_id, verdict))
        yield pd.DataFrame(out, columns=["token", "event_id", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.proof.exists() and self.proof.get()[4] <= expiredTimerInfo.getExpiryTimeInMs():
            self.proof.clear()
        yield pd.DataFrame({"token": pd.Series(dtype=str), "event_id": pd.Series(dtype="int64"), "verdict": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def token_verdicts(events: DataFrame) -> DataFrame:
    """(token, event_id, verdict) of each confirmation in ``events`` (token, event_id, ts, action, teacher, course, version, title).

    A preparation gives the token for 300 seconds, anew if it is repeated. A confirmation is ``expired`` without a live token, ``other`` if teacher or course
    differ, ``changed`` if the course has another version, ``title`` if the title is not the course's, else ``deleted``; ``changed`` and
    ``deleted`` use the token up. Null fields differ from all values. A stream gives the same rows.
    """
    if events.isStreaming:
        return _streamed(events, "token", Tokens(), VERDICTS)
    along = Window.partitionBy("token").orderBy("ts", "event_id")
    given = F.last(F.when(F.col("action") == "prepare", F.struct("ts", "teacher", "course", "version", "title")), ignorenulls=True).over(along)
    turned = events.withColumns({"_p": given, "_turn": F.sum(F.when(F.col("action") == "prepare", 1).otherwise(0)).over(along)}).filter(F.col("action") != "prepare")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"_p.{c}"), F.lit(False))
    alive = F.coalesce(F.col("ts") < F.col("_p.ts") + F.expr(f"INTERVAL {TOKEN_LIFE} SECONDS"), F.lit(False))
    first = F.when(~alive, "expired").when(~(same("teacher") & same("course")), "other").when(~same("version"), "changed").when(~same("title"), "title").otherwise("deleted")
    used = F.max(F.col("_first").isin("changed", "deleted")).over(Window.partitionBy("token", "_turn").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    return turned.withColumn("_first", first).select("token", "event_id", F.when(F.coalesce(used, F.lit(False)), "expired").otherwise(F.col("_first")).alias("verdict"))


# What could not be sent.

SENT = "device long, event_id long, via string"


class Pending(StatefulProcessor):
    """A list a device, of the latest ``most`` events that could not be sent."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", _schema("event_id long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [int(x[0]) for x in self.pending.get()] if self.pending.exists() else []
        out = []
        for r in _in_order(rows).itertuples():
            if r.action == "send" and r.reached:
                out.append((key[0], r.event_id, "direct"))
            elif r.action == "send":
                held.append(r.event_id)
                out += [(key[0], x, "evicted") for x in held[: -self.most]]
                held = held[-self.most :]
            elif r.reached:
                out += [(key[0], x, "flush") for x in held]
                held = []
        if held:
            self.pending.put([(int(x),) for x in held])
        else:
            self.pending.clear()
        yield pd.DataFrame(out, columns=["device", "event_id", "via"])

    def close(self) -> None:
        pass


def sent_events(events: DataFrame, most: int = QUEUE) -> DataFrame:
    """(device, event_id, via) of ``events`` (device, event_id, ts, action, reached): what became of each ``send``.

    A send that reached the log is ``direct``. Others wait; a ``flush`` that reaches the log sends what waits, ``flush``; one that does not changes nothing. Of more than
    ``most`` that wait the oldest is ``evicted``. What still waits has no row. A stream gives the same rows, and ``sinks.append_once`` writes each
    event once, however often it is sent.
    """
    if events.isStreaming:
        return _streamed(events, "device", Pending(most), SENT)
    along = Window.partitionBy("device").orderBy("ts", "event_id")
    waits = (F.col("action") == "send") & ~F.col("reached")
    counted = events.withColumn("_n", F.sum(F.when(waits, 1).otherwise(0)).over(along))
    flushed = F.first(F.when((F.col("action") == "flush") & F.col("reached"), F.col("_n")), ignorenulls=True).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    all_of = F.max("_n").over(Window.partitionBy("device"))
    told = counted.withColumns({"_flush": flushed, "_all": all_of}).filter("action = 'send'")
    via = F.when(F.col("reached"), "direct").when(F.coalesce("_flush", "_all") - F.col("_n") >= most, "evicted").when(F.col("_flush").isNotNull(), "flush")
    return told.select("device", "event_id", via.alias("via")).filter("via IS NOT NULL")


# Refreshes now and then.

REFRESHES = "course string, event_id long, total long, refresh boolean"


def is_due(total: Column, new: Column) -> Column:
    """Derived tables are refreshed for a new student, up to the third event, and at every tenth."""
    return new | (total <= 3) | (total % 10 == 0)


class Refreshes(StatefulProcessor):
    """A count a course and a map of the students seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", _schema("n long"))
        self.seen = handle.getMapState("seen", _schema("student long"), _schema("n long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        total = int(self.total.get()[0]) if self.total.exists() else 0
        out = []
        for r in _in_order(rows).itertuples():
            total += 1
            student = (int(r.student),)
            new = not self.seen.containsKey(student)
            if new:
                self.seen.updateValue(student, (total,))
            out.append((key[0], r.event_id, total, new or total <= 3 or total % 10 == 0))
        self.total.update((total,))
        yield pd.DataFrame(out, columns=["course", "event_id", "total", "refresh"])

    def close(self) -> None:
        pass


def refreshes(events: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """(course, event_id, total, refresh) of ``events`` (course, student, event_id, ts): the how-manieth of its course each is, and whether the
    derived tables are due. Students are not null. A stream gives the same rows.

    The batch form counts slices of time, then within a slice, so that a large course is not one task's.
    """
    if events.isStreaming:
        return _streamed(events, "course", Refreshes(), REFRESHES)
    first = events.groupBy("course", "student").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    placed = events.withColumn("_slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (1_000_000 * slice_seconds)))
    slices = placed.groupBy("course", "_slice").agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.partitionBy("course").orderBy("_slice")) - F.col("_k")
    told = placed.join(slices.select("course", "_slice", before.alias("_before")), ["course", "_slice"]).withColumn("total", F.col("_before") + F.row_number().over(Window.partitionBy("course", "_slice").orderBy("ts", "event_id")))
    new = F.struct("ts", "event_id") == F.col("_first")
    return told.join(first, ["course", "student"]).select("course", "event_id", "total", is_due(F.col("total"), new).alias("refresh"))
