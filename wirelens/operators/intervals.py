"""Regular intervals: inter-arrival statistics and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Thresholds of the coefficient of variation, and of the samples.
MIN_EVENTS, MIN_INTERVALS = 8, 6
CV_HIGH, CV_MEDIUM, CV_LOW, SIZE_CV = 0.30, 0.55, 0.90, 0.5


def cv(n: Column, mean: Column, deviation: Column) -> Column:
    """Deviation over mean; 99 for fewer than two values or a zero mean."""
    return F.when((n >= 2) & (mean != 0), deviation / mean).otherwise(F.lit(99.0))


def interval_stats(events: DataFrame, keys: list[str], ts: str = "ts", size: str | None = None) -> DataFrame:
    """By keys: number of events, of positive intervals between neighbours, their mean, deviation and CV, and the CV
    of sizes above zero (99 for fewer than MIN_INTERVALS of them).

    One shuffle: the window's, which the aggregate reuses.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    dt = (F.col(ts) - F.lag(ts).over(w)).cast("double")
    stepped = events.withColumn("__dt", dt)
    gap, bytes_ = F.when(F.col("__dt") > 0, F.col("__dt")), F.when(F.col(size) > 0, F.col(size).cast("double")) if size else F.lit(None).cast("double")
    out = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count(gap).alias("intervals"), F.avg(gap).alias("mean_interval"), F.stddev_pop(gap).alias("jitter"),
        F.count(bytes_).alias("sized"), F.avg(bytes_).alias("__ms"), F.stddev_pop(bytes_).alias("__ds"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )
    return (
        out.withColumn("cv", cv(F.col("intervals"), F.col("mean_interval"), F.col("jitter")))
        .withColumn("size_cv", F.when(F.col("sized") >= MIN_INTERVALS, cv(F.col("sized"), F.col("__ms"), F.col("__ds"))).otherwise(F.lit(99.0)))
        .drop("__ms", "__ds")
    )


def beacon_verdict(stats: DataFrame) -> DataFrame:
    """stats with severity and confidence of a timer-like schedule, null where there is none."""
    enough = (F.col("events") >= MIN_EVENTS) & (F.col("intervals") >= MIN_INTERVALS)
    grade = F.when(enough & (F.col("cv") < CV_HIGH), 3).when(enough & (F.col("cv") < CV_MEDIUM), 2).when(enough & (F.col("cv") < CV_LOW) & (F.col("size_cv") < SIZE_CV), 1)
    return stats.withColumn("severity", F.when(grade == 3, "HIGH").when(grade == 2, "MEDIUM").when(grade == 1, "LOW")).withColumn(
        "confidence", F.when(grade == 3, "high").when(grade == 2, "medium").when(grade == 1, "low")
    )
