"""Stateful views of events: token budgets, lockouts, sessions, deduplication, running statistics; as streams and in batches.

A stream needs a ``ts`` of type timestamp. Each stream has a batch form over the same events that gives the same rows, by which it is
tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOCK_FAILURES, LOCK_WINDOW, LOCK_TIME = 5, 600, 900  # failures; seconds from the first of them; seconds


def as_instants(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``events`` with ``ts`` as an instant; times without a zone are read in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def rolling_tokens(requests: DataFrame, by: str = "model", seconds: int = 60, slice_seconds: int = 3_600) -> DataFrame:
    """Requests with ``window_tokens``: what was spent in the ``seconds`` up to each request, itself included.

    Requests are summed up in slices of time, no shorter than a window; the last ones of a slice also count in the next. Each request's tokens, whole numbers, are added when
    it comes and taken off when its window has passed, so that a running sum tells what is in a window, however many requests it holds.
    """
    span, reach = max(seconds, slice_seconds) * 1_000_000, seconds * 1_000_000
    at, own = F.col("_at"), F.floor(F.col("_at") / span)
    slices = F.array_distinct(F.array(own, F.floor((at + reach) / span)))
    dealt = requests.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_own", own).withColumn("_slice", F.explode(slices))
    # At one instant what comes is added, then told of, and only then does what came a whole window before go.
    steps = F.array(*(F.struct((at + reach * goes).alias("when"), F.lit(goes).alias("goes")) for goes in (0, 1)))
    moves = dealt.repartition(by, "_slice").withColumn("_step", F.explode(steps)).withColumns({"_when": F.col("_step.when"), "_goes": F.col("_step.goes")})
    sign = F.when(F.col("_goes") == 1, -1).otherwise(1)
    over = Window.partitionBy(by, "_slice").orderBy("_when", "_goes").rangeBetween(Window.unboundedPreceding, 0)
    spent, known = F.sum(F.col("tokens") * sign).over(over), F.sum(F.when(F.col("tokens").isNotNull(), sign)).over(over)
    told = moves.withColumn("window_tokens", spent).withColumn("_known", known).withColumn("window_tokens", F.when(F.col("_known") > 0, F.col("window_tokens")))
    return told.filter((F.col("_slice") == F.col("_own")) & (F.col("_goes") == 0)).drop("_at", "_own", "_slice", "_step", "_when", "_goes", "_known")


def admitted(window_tokens: Column, tokens: Column, per_minute: int = 8000, share: float = 0.82) -> Column:
    """Whether a request fits the budget; one that is alone in its window always does."""
    return (window_tokens <= share * per_minute) | (window_tokens == tokens)


def _attempt(state: tuple[int, int, int], at: int, failed: bool) -> tuple[tuple[int, int, int], bool]:
    """Failures, start of their window and end of the lock after an attempt; and whether it met a lock."""
    failures, start, until = state
    if at < until:
        return state, True
    if not failed:
        return (0, 0, 0), False
    failures, start = (1, at) if not failures or at - start > LOCK_WINDOW else (failures + 1, start)
    if failures >= LOCK_FAILURES:
        return (0, 0, at + LOCK_TIME), False
    return (failures, start, 0), False


def _stretched(attempts: DataFrame, key: str, slice_seconds: int) -> DataFrame:
    """Attempts (key, event_id, at, failed) with ``since``, the first of the stretch of attempts, without a pause of over 15 minutes, that they are in.

    After such a pause no lock and no window is left, so stretches don't depend on each other. Pauses are found in slices of time, then between slices, so that no
    key's attempts are one task's.
    """
    rows = attempts.select(key, "event_id", F.col("ts").cast("timestamp").cast("long").alias("at"), "failed").withColumn("_slice", F.floor(F.col("at") / slice_seconds))
    inner, outer = Window.partitionBy(key, "_slice").orderBy("at", "event_id"), Window.partitionBy(key).orderBy("_slice")
    last = rows.groupBy(key, "_slice").agg(F.max("at").alias("_last")).withColumn("_earlier", F.lag("_last").over(outer)).select(key, "_slice", "_earlier")
    before = F.coalesce(F.lag("at").over(inner), F.col("_earlier"))
    marked = rows.join(last, [key, "_slice"]).withColumn("_start", F.when(before.isNull() | (F.col("at") - before > max(LOCK_TIME, LOCK_WINDOW)), F.col("at")))
    starts = marked.groupBy(key, "_slice").agg(F.max("_start").alias("_latest")).withColumn("_open", F.max("_latest").over(outer.rowsBetween(Window.unboundedPreceding, -1))).select(key, "_slice", "_open")
    since = F.coalesce(F.max("_start").over(inner), F.col("_open"))
    return marked.join(starts, [key, "_slice"]).select(key, "event_id", "at", "failed", since.alias("since"))


def lockouts(attempts: DataFrame, key: str = "user_id", slice_seconds: int = 21_600) -> DataFrame:
    """(key, event_id, locked): whether each attempt (ts, event_id, failed) met a lock. Five failures within ten minutes of the first lock the key for fifteen
    minutes; a success clears them, and attempts at a lock change nothing.

    Stretches of attempts are dealt out and run through in the order of time; a task holds three numbers, however many attempts a stretch has.
    """
    kind = attempts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now = None, (0, 0, 0)
        for batch in batches:
            locks = []
            for k, since, at, failed in zip(*(batch.column(c).to_pylist() for c in (key, "since", "at", "failed"))):
                if (k, since) != of:
                    of, now = (k, since), (0, 0, 0)
                now, locked = _attempt(now, at, bool(failed))
                locks.append(locked)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("event_id"), pa.array(locks, pa.bool_())], names=[key, "event_id", "locked"])

    dealt = _stretched(attempts, key, slice_seconds).repartition(key, "since").sortWithinPartitions(key, "since", "at", "event_id")
    return dealt.mapInArrow(run, f"`{key}` {kind}, event_id long, locked boolean")


def lockout_stream(attempts: DataFrame, key: str = "user_id") -> DataFrame:
    """The same as a stream: attempts of a micro-batch are folded into each key's state in the order of time."""

    def fold(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"])
        out = []
        for at, event_id, failed in zip(rows["at"], rows["event_id"], rows["failed"]):
            now, locked = _attempt(now, int(at), bool(failed))
            out.append((keys[0], event_id, locked))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "event_id", "locked"])

    narrow = attempts.select(key, "event_id", F.col("ts").cast("timestamp").cast("long").alias("at"), "failed")
    return narrow.groupBy(key).applyInPandasWithState(fold, f"{key} long, event_id long, locked boolean", "n int, start long, until long", "append", GroupStateTimeout.NoTimeout)


def valid_sessions(uses: DataFrame, issued: DataFrame, key: str = "user_id", ttl: int = 21600, least: int = 900, most: int = 21600) -> DataFrame:
    """Uses with ``valid``: whether the last session issued to their key before them is still alive. Lives are clamped."""
    life = max(least, min(most, ttl))
    marks = issued.select(key, F.col("ts").alias("_t"), F.lit(None).cast("long").alias("event_id"), F.col("ts").alias("_issued"))
    rows = marks.unionByName(uses.select(key, F.col("ts").alias("_t"), "event_id", F.lit(None).cast(issued.schema["ts"].dataType).alias("_issued")))
    last = F.last("_issued", ignorenulls=True).over(Window.partitionBy(key).orderBy("_t", F.col("_issued").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    told = rows.withColumn("_last", last).filter(F.col("event_id").isNotNull())
    return told.select(key, "event_id", F.coalesce(F.col("_t") < F.col("_last") + F.expr(f"INTERVAL {life} SECONDS"), F.lit(False)).alias("valid"))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """Events once each, in a stream within the delay of the watermark: what is sent again is not counted again."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def running_students(events: DataFrame) -> DataFrame:
    """Counts of each student so far; as a stream in update mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("interactions"), F.count_if(F.col("level") >= 1).alias("confusions"), F.max("ts").alias("last_ts"))


def windowed_modes(events: DataFrame, size: str = "24 hours", step: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each mode in sliding windows; as a stream in append mode, with late events up to the watermark's delay."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    return source.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Stretches of activity of each student (an extension)."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
