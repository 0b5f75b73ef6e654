import tempfile

from pyspark.sql import functions as F
from same import assert_same

from lectern.queries.activity import attempts
from lectern.sources.sinks import append_log
from lectern.streaming import state


def streamed(spark, df, build, mode, files=4):
    """The rows that a stream over ``df``'s files gives, in order of arrival."""
    folder, name = tempfile.mkdtemp(prefix="spark-"), f"t{abs(hash((build.__name__, mode)))}"
    parts = df.withColumn("_f", F.ntile(files).over(__import__("pyspark.sql").sql.Window.orderBy("ts", "event_id")))
    for i in range(1, files + 1):
        parts.filter(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.sql(f"SELECT * FROM {name}")


def events(spark, sf, n=300):
    return state.as_instants(spark.read.parquet(f"{sf}/events.parquet")).filter(F.col("event_id") < n)


def test_lockout_stream_is_its_batch(spark, sf):
    rows = attempts(spark, sf).filter("event_id < 200").withColumn("user_id", F.col("user_id") % 3)
    batch = state.lockouts(rows)
    assert batch.filter("locked").count() > 0
    assert_same(streamed(spark, rows, state.lockout_stream, "append").toPandas(), batch.toPandas())


def test_fifth_failure_locks_and_success_clears(spark):
    def run(*steps):
        rows = spark.createDataFrame([(1, i, at, failed) for i, (at, failed) in enumerate(steps)], "user_id long, event_id long, s long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
        return [r.locked for r in state.lockouts(rows).orderBy("event_id").collect()]

    five = [(i, True) for i in range(5)]
    assert run(*five, (5, False), (904 + 1, False)) == [False] * 5 + [True, False]
    assert run(*five[:4], (4, False), (5, True), (6, False)) == [False] * 7
    assert run(*five[:4], (601, True), (602, False)) == [False] * 6


def test_stretches_are_found_across_slices(spark):
    import random

    rng = random.Random(7)
    rows, at = [], [0, 0]
    for i in range(600):
        u = int(rng.random() < 0.3)
        at[u] += rng.choice((0, 1, 30, 200, 899, 900, 901, 5000))
        rows.append((u, i, at[u], rng.random() < 0.85))
    df = spark.createDataFrame(rows, "user_id long, event_id long, s long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    now, want = {}, {}
    for u, i, s, failed in rows:
        now[u], want[i] = state._attempt(now.get(u, (0, 0, 0)), s, failed)
    for seconds in (21_600, 700):
        assert {r.event_id: r.locked for r in state.lockouts(df, slice_seconds=seconds).collect()} == want
    stretches = state._stretched(df, "user_id", 700)
    assert stretches.select("user_id", "since").distinct().count() > 50 and stretches.count() == 600 and any(want.values())


def test_running_statistics(spark, sf):
    rows = events(spark, sf).withColumn("level", F.when(F.col("event_type") == "error", 1).otherwise(0))
    last = streamed(spark, rows, state.running_students, "update").groupBy("user_id").agg(F.max_by(F.struct("interactions", "confusions", "last_ts"), "interactions").alias("x")).select("user_id", "x.*")
    assert_same(last.toPandas(), state.running_students(rows).toPandas())


def test_windows_with_watermark(spark, sf):
    rows = events(spark, sf)
    done = {(r.start, r.event_type): r.n for r in streamed(spark, rows, state.windowed_modes, "append").collect()}
    whole = {(r.start, r.event_type): r.n for r in state.windowed_modes(rows).collect()}
    assert done and all(whole[k] == n for k, n in done.items())


def test_sent_again_counts_once(spark, sf):
    rows = events(spark, sf, 60)
    assert streamed(spark, rows.unionByName(rows), state.deduplicated, "append").count() == 60


def test_log_is_written_once(spark):
    folder, out = tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-") + "/log"
    spark.createDataFrame([("q" * 900, "r", "abcdefghij")], "question string, response string, sid string").write.mode("append").parquet(folder)
    source = spark.readStream.schema("question string, response string, sid string").parquet(folder)
    seen, mark = [], tempfile.mkdtemp(prefix="spark-")
    for _ in range(2):
        append_log(source, out, mark, lambda log: seen.append(log.count())).awaitTermination(120)
    row = spark.read.parquet(out).collect()
    assert len(row) == 1 and len(row[0].question) == 500 and row[0].sid == "ABCDEFGH" and seen == [1]


def test_crowded_windows_take_a_running_sum(spark):
    import time

    from pyspark.sql import functions as F

    from lectern.streaming import state

    n = 150_000
    rows = spark.range(n).select(F.lit("m").alias("model"), "id", F.timestamp_seconds(F.col("id") / 100 + 7200).alias("ts"), F.when(F.col("id") > 0, 1).alias("tokens"))
    start = time.time()
    got = state.rolling_tokens(rows, seconds=1000, slice_seconds=100_000).select((F.col("window_tokens") - F.least(F.col("id"), F.lit(100_001))).alias("off")).groupBy("off").count().collect()
    assert {r.off: r["count"] for r in got} == {None: 1, 0: n - 1}
    assert time.time() - start < 15
