"""Queries of keyed state, in its batch forms, and of entries merged as they arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import knowledge
from lectern.queries import Catalogue
from lectern.sources.tables import table
from lectern.streaming import keyed

KEYED = Catalogue()


@KEYED.add("throttled_refresh", "course string, event_id bigint, total bigint, refresh boolean", """
WITH e AS (SELECT event_type AS course, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS total, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS nth FROM events)
SELECT course, event_id, total, nth = 1 OR total <= 3 OR total % 10 = 0 AS refresh FROM e""")
def _(spark, sf):
    return keyed.refreshes(table(spark, sf, "events").select(F.col("event_type").alias("course"), F.col("user_id").alias("student"), "event_id", "ts"), slice_seconds=86400)


@KEYED.add("offline_queue", "device bigint, event_id bigint, via string", """
WITH e AS (SELECT user_id AS device, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_id % 9 = 4 AS flush, event_id % 3 = 1 AS reached FROM events),
w AS (SELECT s.*, (SELECT min(f.i) FROM e f WHERE f.device = s.device AND f.flush AND f.reached AND f.i > s.i) AS flush_i FROM e s WHERE NOT s.flush AND NOT s.reached),
k AS (SELECT w.device, w.event_id, w.flush_i, count(o.i) AS newer FROM w LEFT JOIN w o ON o.device = w.device AND o.i > w.i AND (w.flush_i IS NULL OR o.i < w.flush_i) GROUP BY ALL)
SELECT device, event_id, 'direct' AS via FROM e WHERE NOT flush AND reached UNION ALL SELECT device, event_id, CASE WHEN newer >= 3 THEN 'evicted' ELSE 'flush' END FROM k WHERE newer >= 3 OR flush_i IS NOT NULL""")
def _(spark, sf):
    e = F.col("event_id")
    events = table(spark, sf, "events").select(F.col("user_id").alias("device"), "event_id", "ts", F.when(e % 9 == 4, "flush").otherwise("send").alias("action"), (e % 3 == 1).alias("reached"))
    return keyed.sent_events(events, most=3)


@KEYED.add("deletion_tokens", "token string, event_id bigint, verdict string", """
WITH RECURSIVE e AS (
  SELECT (user_id % 40)::VARCHAR AS token, event_id, epoch_us(ts) // 40000000 AS s, event_id % 4 = 0 AS prepares, CASE WHEN event_id % 11 = 3 THEN 'eva' ELSE 'ana' END AS teacher, CASE WHEN event_id % 13 = 5 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN event_id % 5 < 3 THEN 'T' ELSE 'U' END AS title,
         row_number() OVER (PARTITION BY user_id % 40 ORDER BY epoch_us(ts) // 40000000, event_id) AS i FROM events),
walk AS (
  SELECT token, 0::BIGINT AS event_id, 0::BIGINT AS i, NULL::VARCHAR AS verdict, NULL::VARCHAR AS p_teacher, NULL::VARCHAR AS p_version, NULL::VARCHAR AS p_title, 0::BIGINT AS until FROM (SELECT DISTINCT token FROM e)
  UNION ALL
  SELECT token, event_id, i, verdict, CASE WHEN prepares THEN teacher ELSE p_teacher END, CASE WHEN prepares THEN version ELSE p_version END, CASE WHEN prepares THEN title ELSE p_title END, CASE WHEN prepares THEN s + 300 WHEN verdict IN ('changed', 'deleted') THEN 0 ELSE until END
  FROM (SELECT e.*, w.p_teacher, w.p_version, w.p_title, w.until, CASE WHEN e.prepares THEN NULL WHEN e.s >= w.until THEN 'expired' WHEN e.teacher <> w.p_teacher THEN 'other' WHEN e.version <> w.p_version THEN 'changed' WHEN e.title <> w.p_title THEN 'title' ELSE 'deleted' END AS verdict FROM walk w JOIN e ON e.token = w.token AND e.i = w.i + 1))
SELECT token, event_id, verdict FROM walk WHERE verdict IS NOT NULL""")
def _(spark, sf):
    e, pick = F.col("event_id"), lambda c, a, b: F.when(c, a).otherwise(b)
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 40).cast("string").alias("token"), "event_id", F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 40_000_000)).alias("ts"), pick(e % 4 == 0, "prepare", "confirm").alias("action"),
        pick(e % 11 == 3, "eva", "ana").alias("teacher"), F.lit("c").alias("course"), pick(e % 13 == 5, "v2", "v1").alias("version"), pick(e % 5 < 3, "T", "U").alias("title"),
    )
    return keyed.token_verdicts(events)


@KEYED.add("arrival_groups", "entry_id bigint, root bigint", """
WITH RECURSIVE e AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS i, ['a' || s_suppkey * s_suppkey % 61, 'b' || s_suppkey * 7 % 53, 'c' || s_nationkey % 20] AS names FROM supplier),
walk AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS id, NULL::BIGINT AS root, MAP {}::MAP(VARCHAR, BIGINT) AS owner
  UNION ALL
  SELECT i, id, root, map_concat(owner, map(names, list_transform(names, lambda n: root))) FROM (SELECT e.*, w.owner, coalesce(w.owner[list_filter(e.names, lambda n: w.owner[n] IS NOT NULL)[1]], e.id) AS root FROM walk w JOIN e ON e.i = w.i + 1))
SELECT id AS entry_id, root FROM walk WHERE id IS NOT NULL""")
def _(spark, sf):
    k, name = F.col("s_suppkey"), lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    entries = table(spark, sf, "supplier").select(k.alias("entry_id"), name("a", k * k % 61).alias("term"), F.array(name("b", k * 7 % 53), name("c", F.col("s_nationkey") % 20)).alias("aliases"))
    return knowledge.arrival_groups(entries)
