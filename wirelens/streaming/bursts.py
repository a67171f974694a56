"""Unbounded input: capture chunks as they arrive, scan bursts by session window, and timer-like senders by kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import CV_HIGH, CV_MEDIUM, MIN_EVENTS

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet event files that arrive in folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def bursts(events: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key's events, closed by a gap; events later than `late` are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return w.agg(F.count(F.lit(1)).alias("events"), F.approx_count_distinct("event_type").alias("kinds")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "kinds"
    )


def tumbling_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), key)
    return w.agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "events", "value")


def timers(events: DataFrame, key: str, idle_ms: int = 3_600_000) -> DataFrame:
    """A key's intervals so far, updated with each batch: events, mean, cv, verdict.

    The state is five numbers a key (Welford's sums over intervals), so it doesn't grow with the stream; keys that
    stay idle are let go.
    """
    out = "key long, events long, mean_interval double, cv double, verdict string"
    state = "events long, n long, mean double, m2 double, last double"

    def update(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        events_, n, mean, m2, last = held.get if held.exists else (0, 0, 0.0, 0.0, float("nan"))
        times = sorted(t.timestamp() for b in batches for t in b["ts"])
        for t in times:
            events_ += 1
            if last == last and t > last:
                n += 1
                step = (t - last) - mean
                mean += step / n
                m2 += step * ((t - last) - mean)
            last = t if last != last else max(last, t)
        held.update((events_, n, mean, m2, last))
        held.setTimeoutDuration(idle_ms)
        cv = (m2 / n) ** 0.5 / mean if n > 1 and mean else 99.0
        verdict = "none" if events_ < MIN_EVENTS else "HIGH" if cv < CV_HIGH else "MEDIUM" if cv < CV_MEDIUM else "none"
        yield pd.DataFrame({"key": [k[0]], "events": [events_], "mean_interval": [mean], "cv": [cv], "verdict": [verdict]})

    return events.groupBy(key).applyInPandasWithState(update, out, state, "update", GroupStateTimeout.ProcessingTimeTimeout)
