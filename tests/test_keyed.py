"""Streams of keyed state against their batch forms; sinks that write once."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from same import assert_same
from test_state import streamed

from lectern.sources.sinks import append_once
from lectern.streaming import keyed

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def token_events(spark):
    rng = random.Random(3)
    rows = []
    for token in range(30):
        t = 30 * token
        for k in range(7):
            t += rng.choice((20, 90, 140, 299, 300))
            same = lambda right, wrong, odds=0.8: right if rng.random() < odds else wrong
            rows.append((f"t{token}", at(t), "prepare" if k == 0 or rng.random() < 0.2 else "confirm", same("ana", "eva"), same("c1", None, 0.9), same("v1", "v2"), same("Fonética", "Otra", 0.6)))
    rows.sort(key=lambda r: r[1])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, token string, ts timestamp, action string, teacher string, course string, version string, title string")


def plain_tokens(rows):
    held, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        if r.action == "prepare":
            held[r.token] = r
            continue
        p = held.get(r.token)
        if p is None or r.ts >= p.ts + timedelta(seconds=300):
            out[r.event_id] = "expired"
        elif r.teacher != p.teacher or r.course is None or r.course != p.course:
            out[r.event_id] = "other"
        else:
            out[r.event_id] = "changed" if r.version != p.version else "deleted" if r.title == p.title else "title"
            if out[r.event_id] != "title":
                del held[r.token]
    return out


def test_tokens(spark):
    events = token_events(spark)
    batch = keyed.token_verdicts(events)
    assert {r.event_id: r.verdict for r in batch.collect()} == plain_tokens(events.collect())
    assert {r.verdict for r in batch.collect()} == {"expired", "other", "changed", "title", "deleted"}


def test_token_stream(spark):
    events = token_events(spark)
    assert_same(streamed(spark, events, keyed.token_verdicts, "append", 3).toPandas(), keyed.token_verdicts(events).toPandas())


def test_a_token_is_used_once(spark):
    ok = ("ana", "c1", "v1", "T")
    steps = [(0, "prepare"), (10, "confirm"), (11, "confirm"), (20, "prepare"), (320, "confirm"), (330, "prepare"), (629, "confirm")]
    events = spark.createDataFrame([(i, "t", at(s), a, *ok) for i, (s, a) in enumerate(steps)], "event_id long, token string, ts timestamp, action string, teacher string, course string, version string, title string")
    assert [r.verdict for r in keyed.token_verdicts(events).orderBy("event_id").collect()] == ["deleted", "expired", "expired", "deleted"]


def queue_events(spark, n=120):
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), at(10 * i), "flush" if rng.random() < 0.12 else "send", rng.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, device long, ts timestamp, action string, reached boolean")


def test_queue(spark):
    events = queue_events(spark)
    for most in (2, 100):
        held, want = {}, set()
        for r in events.collect():
            mine = held.setdefault(r.device, [])
            if r.action == "send" and r.reached:
                want.add((r.device, r.event_id, "direct"))
            elif r.action == "send":
                mine.append(r.event_id)
                want |= {(r.device, x, "evicted") for x in mine[:-most]}
                del mine[:-most]
            elif r.reached:
                want |= {(r.device, x, "flush") for x in mine}
                mine.clear()
        rows = [tuple(r) for r in keyed.sent_events(events, most).collect()]
        assert set(rows) == want and len(rows) == len(want)


def test_queue_stream_and_sink(spark):
    events = queue_events(spark)
    batch = keyed.sent_events(events, 2)
    streamed_rows = streamed(spark, events, lambda e: keyed.sent_events(e, 2), "append", 3)
    assert_same(streamed_rows.toPandas(), batch.toPandas())


def test_what_is_sent_again_is_written_once(spark):
    folder, out, mark = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    write = lambda ids: spark.createDataFrame([(i, "x") for i in ids], "event_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda m: append_once(spark.readStream.schema("event_id long, text string").parquet(folder), f"{out}/log", m, "event_id").awaitTermination(120)
    write([1, 2, 2, 3])
    stream(mark)
    write([3, 4])
    stream(mark)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/log").collect()) == [1, 2, 3, 4]
    # A run that lost its mark starts from the beginning: batches are written over, nothing is doubled.
    stream(tempfile.mkdtemp(prefix="spark-"))
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/log").collect()) == [1, 2, 3, 4]


def refresh_events(spark, n=90):
    rng = random.Random(6)
    return spark.createDataFrame([(i, f"c{min(2, rng.randrange(6))}", rng.randrange(12), at(7 * (i // 2))) for i in range(n)], "event_id long, course string, student long, ts timestamp")


@pytest.mark.parametrize("seconds", [3600, 20])
def test_refreshes(spark, seconds):
    events = refresh_events(spark)
    seen, total, want = set(), {}, {}
    for r in events.orderBy("ts", "event_id").collect():
        total[r.course] = n = total.get(r.course, 0) + 1
        want[r.event_id] = (n, (r.course, r.student) not in seen or n <= 3 or n % 10 == 0)
        seen.add((r.course, r.student))
    assert {r.event_id: (r.total, r.refresh) for r in keyed.refreshes(events, seconds).collect()} == want


def test_refresh_stream(spark):
    events = refresh_events(spark)
    assert_same(streamed(spark, events, keyed.refreshes, "append", 3).toPandas(), keyed.refreshes(events).toPandas())
    assert keyed.refreshes(events.filter(F.lit(False))).count() == 0
