"""Queries of learner activity and of stateful views of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.fixed import USAGE_LEVELS
from lectern.operators import analytics
from lectern.queries import Catalogue
from lectern.queries.texts import fold_sql
from lectern.sources.tables import ACTIVITY_SQL, bibliography, commissions, concept_links, concepts, interactions, roster, table
from lectern.streaming import state

ACTIVITY = Catalogue()

WITH = f"WITH {ACTIVITY_SQL}"
STATS_SQL = """
stats AS (
  SELECT dni, count(*) AS interactions, count(DISTINCT sid) AS sessions, count(DISTINCT mode) AS modes, count(*) FILTER (level >= 1) AS possible_confusion, count(*) FILTER (level >= 2) AS repeated_confusion, min(ts) AS first_ts, max(ts) AS last_ts,
         coalesce((SELECT count(DISTINCT c) FROM (SELECT l2.dni AS d, unnest(l2.concept_ids) AS c FROM log l2) WHERE d = log.dni), 0) AS concepts
  FROM log GROUP BY dni)"""
STAMP = "yyyy-MM-dd HH:mm:ss"


def stamp_sql(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


STUDENT = "dni bigint, interactions bigint, sessions bigint, modes bigint, concepts bigint, possible_confusion bigint, repeated_confusion bigint"


@ACTIVITY.add("student_stats", STUDENT + ", first_ts string, last_ts string", f"{WITH}, {STATS_SQL} SELECT * REPLACE ({stamp_sql('first_ts')} AS first_ts, {stamp_sql('last_ts')} AS last_ts) FROM stats")
def _(spark, sf):
    return analytics.student_stats(interactions(spark, sf)).withColumns({c: F.date_format(c, STAMP) for c in ("first_ts", "last_ts")})


@ACTIVITY.add("student_status", STUDENT + ", name string, commission string, enrolled boolean, status string", f"""{WITH}, {STATS_SQL}
SELECT dni, coalesce(interactions, 0) AS interactions, coalesce(sessions, 0) AS sessions, coalesce(modes, 0) AS modes, coalesce(concepts, 0) AS concepts, coalesce(possible_confusion, 0) AS possible_confusion, coalesce(repeated_confusion, 0) AS repeated_confusion,
       coalesce(name, dni::VARCHAR) AS name, coalesce(commission, '') AS commission, name IS NOT NULL AS enrolled, CASE WHEN interactions > 0 THEN 'Activo' ELSE 'Sin actividad' END AS status
FROM roster FULL JOIN stats USING (dni)""")
def _(spark, sf):
    return analytics.student_status(roster(spark, sf), analytics.student_stats(interactions(spark, sf)))


CONCEPTS_SQL = """
concepts AS (SELECT p_partkey AS concept_id, p_name AS title FROM part),
told AS (SELECT dni, level, ts, unnest(concept_ids) AS concept_id FROM log),
used AS (SELECT concept_id, count(*) AS interactions, count(DISTINCT dni) AS students, count(*) FILTER (level >= 1) AS possible_confusion, count(*) FILTER (level >= 2) AS repeated_confusion FROM told GROUP BY concept_id),
concept_stats AS (
  SELECT concept_id, title, coalesce(interactions, 0) AS interactions, coalesce(students, 0) AS students, coalesce(possible_confusion, 0) AS possible_confusion, coalesce(repeated_confusion, 0) AS repeated_confusion, CASE WHEN interactions > 0 THEN possible_confusion::DOUBLE / interactions ELSE 0 END AS confusion_ratio
  FROM concepts LEFT JOIN used USING (concept_id))"""
CONCEPT = "concept_id bigint, title string, interactions bigint, students bigint, possible_confusion bigint, repeated_confusion bigint, confusion_ratio double"


def _concept_stats(spark, sf):
    return analytics.concept_stats(concepts(spark, sf), interactions(spark, sf))


@ACTIVITY.add("concept_stats", CONCEPT, f"{WITH}, {CONCEPTS_SQL} SELECT * FROM concept_stats")
def _(spark, sf):
    return _concept_stats(spark, sf)


@ACTIVITY.add("top_concepts", CONCEPT, f"{WITH}, {CONCEPTS_SQL} SELECT * FROM concept_stats ORDER BY interactions DESC, possible_confusion DESC, concept_id LIMIT 12")
def _(spark, sf):
    return analytics.top_concepts(_concept_stats(spark, sf))


@ACTIVITY.add("top_confused", CONCEPT, f"{WITH}, {CONCEPTS_SQL} SELECT * FROM concept_stats WHERE possible_confusion > 0 ORDER BY possible_confusion DESC, interactions DESC, concept_id LIMIT 12")
def _(spark, sf):
    return analytics.top_concepts(_concept_stats(spark, sf), by="possible_confusion")


@ACTIVITY.add("concept_bibliography", "concept_id bigint, n_sources bigint, sources string", "SELECT l_partkey AS concept_id, count(*) AS n_sources, string_agg(s_name || ' · ' || s_nationkey, '; ' ORDER BY s_suppkey) AS sources FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def _(spark, sf):
    return analytics.concept_sources(concept_links(spark, sf), bibliography(spark, sf))


MATCH_SQL = f"""
spelt AS (SELECT DISTINCT commission AS value FROM roster WHERE trim(commission) <> '' UNION SELECT DISTINCT commission FROM log WHERE trim(commission) <> ''),
folded AS (SELECT value, trim({fold_sql('value')}) AS v FROM spelt),
declared AS (SELECT value, commission_id FROM folded, (SELECT commission_id, trim({fold_sql('code')}) AS c, trim({fold_sql('title')}) AS t FROM commissions) WHERE v = c OR v = t OR v = 'comision ' || c OR (contains(v, c) AND contains(v, 'comision')) OR contains(v, t)),
groups AS (SELECT * FROM declared UNION ALL SELECT value, 'extra:' || value FROM spelt WHERE value NOT IN (SELECT value FROM declared))"""


def _groups(spark, sf):
    values = roster(spark, sf).select(F.col("commission").alias("value")).union(interactions(spark, sf).select("commission"))
    return analytics.commission_groups(values, commissions(spark, sf))


@ACTIVITY.add("commission_groups", "value string, commission_id string", f"{WITH}, {MATCH_SQL} SELECT * FROM groups")
def _(spark, sf):
    return _groups(spark, sf)


@ACTIVITY.add("commission_stats", "commission_id string, students bigint, active_students bigint, interactions bigint, confusion bigint", f"""{WITH}, {MATCH_SQL},
s AS (SELECT commission_id, count(*) AS students, count(*) FILTER (dni IN (SELECT dni FROM log)) AS active_students FROM roster JOIN groups ON commission = value GROUP BY commission_id),
i AS (SELECT commission_id, count(*) AS interactions, count(*) FILTER (level >= 1) AS confusion FROM log JOIN groups ON commission = value GROUP BY commission_id),
k AS (SELECT commission_id FROM commissions UNION SELECT commission_id FROM groups)
SELECT commission_id, coalesce(students, 0) AS students, coalesce(active_students, 0) AS active_students, coalesce(interactions, 0) AS interactions, coalesce(confusion, 0) AS confusion FROM k LEFT JOIN s USING (commission_id) LEFT JOIN i USING (commission_id)""")
def _(spark, sf):
    return analytics.commission_stats(_groups(spark, sf), commissions(spark, sf), roster(spark, sf), interactions(spark, sf))


@ACTIVITY.add("commission_unmatched", "value string", f"{WITH}, {MATCH_SQL} SELECT value FROM groups WHERE starts_with(commission_id, 'extra:')")
def _(spark, sf):
    return _groups(spark, sf).filter(F.startswith("commission_id", F.lit("extra:"))).select("value")


@ACTIVITY.add("commission_first_day", "value string, commission_id string", f"""{WITH}, spelt AS (SELECT DISTINCT commission AS value FROM roster),
hits AS (SELECT value, commission_id, row_number() OVER (PARTITION BY value ORDER BY value <> title, nth) AS r FROM spelt JOIN commissions ON value = title OR contains({fold_sql('value')}, {fold_sql('day')}))
SELECT value, commission_id FROM spelt LEFT JOIN (SELECT * FROM hits WHERE r = 1) USING (value)""")
def _(spark, sf):
    return analytics.first_commission(roster(spark, sf).select(F.col("commission").alias("value")), commissions(spark, sf))


@ACTIVITY.add("mode_share", "mode string, interactions bigint, share double", f"{WITH} SELECT coalesce(nullif(mode, ''), 'Sin modo') AS mode, count(*) AS interactions, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM log GROUP BY 1")
def _(spark, sf):
    return analytics.mode_share(interactions(spark, sf))


@ACTIVITY.add("global_summary", "students bigint, active bigint, inactive bigint, interactions bigint, mean_interactions double, confusions bigint, last_ts string", f"{WITH} SELECT students, active, greatest(0, students - active) AS inactive, interactions, interactions::DOUBLE / active AS mean_interactions, confusions, {stamp_sql('last_ts')} AS last_ts FROM (SELECT count(*) AS students FROM roster), (SELECT count(*) AS interactions, count(DISTINCT dni) AS active, count(*) FILTER (level >= 1) AS confusions, max(ts) AS last_ts FROM log)")
def _(spark, sf):
    return analytics.summary(roster(spark, sf), interactions(spark, sf)).withColumn("last_ts", F.date_format("last_ts", STAMP))


@ACTIVITY.add("last_24_hours", "event_id bigint, dni bigint", f"{WITH} SELECT event_id, dni FROM log WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def _(spark, sf):
    log = interactions(spark, sf)
    now = log.agg(F.max("ts")).first()[0]
    return analytics.last_hours(log, F.lit(now).cast("timestamp_ntz"))


@ACTIVITY.add("usage_levels", "dni bigint, level string, rank bigint, note string", f"""{WITH}, {STATS_SQL}, s AS (SELECT dni, interactions AS n, possible_confusion::DOUBLE / interactions AS r, possible_confusion AS c, concepts AS k FROM stats),
l AS (SELECT *, CASE WHEN n < 3 THEN '{USAGE_LEVELS[1]}' WHEN r > 0.35 THEN '{USAGE_LEVELS[2]}' WHEN n < 8 THEN '{USAGE_LEVELS[3]}' ELSE '{USAGE_LEVELS[4]}' END AS level FROM s)
SELECT dni, level, CASE level WHEN '{USAGE_LEVELS[1]}' THEN 1 WHEN '{USAGE_LEVELS[2]}' THEN 2 WHEN '{USAGE_LEVELS[3]}' THEN 3 ELSE 4 END AS rank,
       coalesce(nullif(concat_ws(' · ', CASE WHEN r > 0.5 THEN '⚠ Confusión frecuente — intervención recomendada' WHEN r > 0.35 THEN 'Señales de dificultad conceptual' END, CASE WHEN k >= 8 THEN 'Amplia exploración: ' || k || ' conceptos distintos' END,
       CASE WHEN k <= 2 AND n >= 5 THEN 'Consultas repetitivas — poca variedad conceptual' END, CASE WHEN n >= 15 THEN 'Alta participación' END, CASE WHEN n = 1 THEN 'Una sola consulta' END), ''), 'Uso normal') AS note FROM l""")
def _(spark, sf):
    n, c = F.col("interactions"), F.col("possible_confusion")
    stats = analytics.student_stats(interactions(spark, sf)).withColumn("level", analytics.usage_level(n, c))
    return stats.select("dni", "level", analytics.usage_rank(F.col("level")).alias("rank"), analytics.usage_note(n, c, F.col("concepts")).alias("note"))


@ACTIVITY.add("written_levels", "event_id bigint, level bigint, label string, mode string", f"""
SELECT event_id, level, CASE level WHEN 2 THEN 'Reiterada' WHEN 1 THEN 'Posible' ELSE 'Sin indicio' END AS label, mode
FROM (SELECT event_id, CASE WHEN v = 0 AND event_id % 3 = 0 AND event_type <> 'view' THEN 1 ELSE v END AS level, CASE event_type WHEN 'click' THEN 'Análisis' ELSE 'Consulta' END AS mode
      FROM (SELECT *, greatest(0, least(2, floor(value / 100 + 0.5))) AS v FROM events))""")
def _(spark, sf):
    question = F.when(F.col("event_id") % 3 == 0, "no entiendo esto").otherwise("gracias")
    ids = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit("c1")))
    level = analytics.written_level((F.col("value") / 100).cast("string"), question, ids)
    mode = analytics.mode_label(F.when(F.col("event_type") == "click", "analisis").otherwise(F.col("event_type")))
    return table(spark, sf, "events").select("event_id", level.alias("level"), analytics.confusion_label(level).alias("label"), mode.alias("mode"))


# Stateful views, in their batch form; the streams are held against these by tests.

@ACTIVITY.add("rolling_token_budget", "event_id bigint, window_tokens bigint, admitted boolean", "SELECT event_id, w AS window_tokens, w <= 0.82::DOUBLE * 8000 OR w = tokens AS admitted FROM (SELECT *, sum(tokens) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6000 SECONDS PRECEDING AND CURRENT ROW) AS w FROM (SELECT event_id, event_type, ts, floor(value * 20)::BIGINT AS tokens FROM events))")
def _(spark, sf):
    requests = table(spark, sf, "events").select("event_id", F.col("event_type").alias("model"), "ts", F.floor(F.col("value") * 20).alias("tokens"))
    return state.rolling_tokens(requests, seconds=6000).select("event_id", "window_tokens", state.admitted(F.col("window_tokens"), F.col("tokens")).alias("admitted"))


def attempts(spark, sf):
    """Events as log-ins, two hours drawn together to a second: four of five fail."""
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 7_200_000_000))
    return table(spark, sf, "events").select("user_id", "event_id", ts.alias("ts"), (F.col("event_id") % 5 < 4).alias("failed"))


@ACTIVITY.add("login_lockout", "user_id bigint, event_id bigint, locked boolean", """
WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) // 7200000000 AS tm, event_id % 5 < 4 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 7200000000, event_id) AS i FROM events),
walk AS (
  SELECT user_id, event_id, i, false AS locked, CASE WHEN failed THEN 1 ELSE 0 END AS n, CASE WHEN failed THEN tm ELSE 0 END AS start, 0::BIGINT AS until FROM a WHERE i = 1
  UNION ALL
  SELECT a.user_id, a.event_id, a.i, a.tm < w.until,
         CASE WHEN a.tm < w.until THEN w.n WHEN NOT a.failed THEN 0 WHEN w.n = 0 OR a.tm - w.start > 600 THEN 1 WHEN w.n + 1 >= 5 THEN 0 ELSE w.n + 1 END,
         CASE WHEN a.tm < w.until THEN w.start WHEN NOT a.failed THEN 0 WHEN w.n = 0 OR a.tm - w.start > 600 THEN a.tm WHEN w.n + 1 >= 5 THEN 0 ELSE w.start END,
         CASE WHEN a.tm < w.until THEN w.until WHEN a.failed AND w.n > 0 AND a.tm - w.start <= 600 AND w.n + 1 >= 5 THEN a.tm + 900 ELSE 0 END
  FROM walk w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1)
SELECT user_id, event_id, locked FROM walk""")
def _(spark, sf):
    return state.lockouts(attempts(spark, sf))


@ACTIVITY.add("session_ttl", "user_id bigint, event_id bigint, valid boolean", "SELECT u.user_id, u.event_id, coalesce(u.ts < max(i.ts) + INTERVAL 21600 SECONDS, false) AS valid FROM events u LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') i ON i.user_id = u.user_id AND i.ts <= u.ts WHERE u.event_type <> 'signup' GROUP BY u.user_id, u.event_id, u.ts")
def _(spark, sf):
    events = table(spark, sf, "events")
    return state.valid_sessions(events.filter("event_type <> 'signup'"), events.filter("event_type = 'signup'"))


@ACTIVITY.add("dedupe_events", "event_id bigint", "SELECT DISTINCT event_id FROM events")
def _(spark, sf):
    events = table(spark, sf, "events")
    return state.deduplicated(events.unionByName(events.filter("event_id % 3 = 0")))


@ACTIVITY.add("running_students", "user_id bigint, interactions bigint, confusions bigint, last_ts string", f"SELECT user_id, count(*) AS interactions, count(*) FILTER (event_type = 'error') AS confusions, {stamp_sql('max(ts)')} AS last_ts FROM events GROUP BY user_id")
def _(spark, sf):
    events = table(spark, sf, "events").withColumn("level", F.when(F.col("event_type") == "error", 1).otherwise(0))
    return state.running_students(events).withColumn("last_ts", F.date_format("last_ts", STAMP))


@ACTIVITY.add("windowed_modes", "start string, event_type string, n bigint", f"SELECT {stamp_sql('s')} AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOURS, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1, 2")
def _(spark, sf):
    return state.windowed_modes(state.as_instants(table(spark, sf, "events"))).withColumn("start", F.date_format("start", STAMP))


@ACTIVITY.add("session_windows", "user_id bigint, start string, n bigint", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, {stamp_sql('min(ts)')} AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf):
    return state.session_windows(state.as_instants(table(spark, sf, "events"))).withColumn("start", F.date_format("start", STAMP))


@ACTIVITY.add("cube_mode_day", "mode string, sid string, n bigint", f"{WITH} SELECT mode, sid, count(*) AS n FROM log GROUP BY CUBE (mode, sid)")
def _(spark, sf):
    return interactions(spark, sf).cube("mode", "sid").agg(F.count("*").alias("n"))
