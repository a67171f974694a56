import datetime

from pyspark.sql import functions as F

from wirelens.streaming import bursts


def write(spark, folder, rows):
    df = spark.createDataFrame([(k, t, u, "view", 1.0, "{}") for k, (t, u) in enumerate(rows)], bursts.EVENTS)
    df.coalesce(1).write.mode("append").parquet(folder)


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions_and_timers(spark, tmp_path):
    t0, folder = datetime.datetime(2024, 1, 1), str(tmp_path / "in")
    minute = datetime.timedelta(minutes=1)
    write(spark, folder, [(t0 + k * minute, 1) for k in range(10)] + [(t0 + 60 * minute, 1), (t0, 2)])
    write(spark, folder, [(t0 + (k + 10) * minute, 1) for k in range(5)])
    events = bursts.read_events(spark, folder, 1)
    got = {(r.user_id, r.events) for r in run(bursts.bursts(events, "user_id", late="3 hours"), "bursts", "complete").collect()}
    assert got == {(1, 15), (1, 1), (2, 1)}
    counts = run(bursts.tumbling_counts(events, "user_id", late="3 hours"), "tumbling", "complete")
    assert counts.agg(F.sum("events")).first()[0] == 17
    last = run(bursts.timers(events, "user_id"), "timers", "update").where("key = 1").agg(F.max_by("events", "events"), F.max("events")).first()
    assert last[1] == 16
