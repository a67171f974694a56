"""The findings table: one schema for all detectors, ranking, score and timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.lookups import CONFIDENCE_FACTOR, SEVERITY_WEIGHT, TECHNIQUES

MITRE = "array<struct<technique:string,tactic:string,name:string,why:string>>"
SCHEMA = (
    "id string, title string, severity string, confidence string, description string, explanation string, verification string, evidence array<string>, hosts array<string>, "
    f"protocol string, first_ts double, last_ts double, packet_refs array<string>, wireshark_filters array<string>, mitre {MITRE}"
)
COLUMNS = [c.strip().split(" ")[0] for c in SCHEMA.replace(MITRE, "m").split(",")]


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _strings(values: list) -> Column:
    return F.filter(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), lambda x: x.isNotNull()) if values else F.array().cast("array<string>")


def finding(df: DataFrame, *, id: Column, title, severity, confidence, description, explanation: str, verification, protocol, evidence=(), hosts=None, first_ts=None, last_ts=None, filters=(), mitre=()) -> DataFrame:
    """A finding for each row of df."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    refs = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("technique", "tactic", "name", "why"), (t, *TECHNIQUES.get(t, ("", "")), why))]) if isinstance(t, str) else t for t, why in mitre]
    return df.select(
        as_col(id).alias("id"), as_col(title).alias("title"), as_col(severity).alias("severity"), as_col(confidence).alias("confidence"), as_col(description).alias("description"),
        F.lit(explanation).alias("explanation"), as_col(verification).alias("verification"), _strings(list(evidence)).alias("evidence"),
        (hosts if hosts is not None else F.array().cast("array<string>")).alias("hosts"), as_col(protocol).alias("protocol"), as_col(first_ts).cast("double").alias("first_ts"),
        as_col(last_ts).cast("double").alias("last_ts"), F.array().cast("array<string>").alias("packet_refs"), _strings(list(filters)).alias("wireshark_filters"),
        (F.array(*refs) if refs else F.array()).cast(MITRE).alias("mitre"),
    )


def conform(df: DataFrame) -> DataFrame:
    """Findings with exactly the table's columns and types, as detectors of users may differ in them."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMA)])


def mitre_column(technique: Column, why: str) -> Column:
    tactic, name = (_map({k: v[n] for k, v in TECHNIQUES.items()})[technique] for n in (0, 1))
    return F.struct(technique.alias("technique"), tactic.alias("tactic"), name.alias("name"), F.lit(why).alias("why"))


def capped(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows in order: a detector reports no more."""
    return df.orderBy(*order).limit(n)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ranked(findings: DataFrame) -> DataFrame:
    """Of findings of one id the most severe; then by severity, confidence and id."""
    sev, conf = -_map(SEVERITY_WEIGHT)[F.col("severity")], -_map(CONFIDENCE_FACTOR)[F.col("confidence")]
    w = Window.partitionBy("id").orderBy(sev, conf)
    return findings.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k").orderBy(sev, conf, "id")


def risk_score(findings: DataFrame) -> DataFrame:
    """score: the strongest contribution and a quarter of the others, at most 100, rounded half to even; and its label."""
    c = _map(SEVERITY_WEIGHT)[F.col("severity")] * _map(CONFIDENCE_FACTOR)[F.col("confidence")]
    s = findings.select(c.alias("c")).agg(F.coalesce(F.max("c") + 0.25 * (F.sum("c") - F.max("c")), F.lit(0.0)).alias("s"))
    score = F.least(F.lit(100), F.bround("s", 0).cast("int"))
    return s.select(score.alias("score")).withColumn(
        "label", F.when(F.col("score") >= 80, "critical").when(F.col("score") >= 60, "high").when(F.col("score") >= 35, "elevated").when(F.col("score") > 0, "low").otherwise("none")
    )


def severity_breakdown(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


# Events of a kind, and of all, in a timeline.
TIMELINE_CAPS = {"dns": 300, "http": 300, "stream": 200, "credential": 150, "finding": 100}
TIMELINE_CAP = 600


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """kind, ts, host, severity, text of all kinds by time; parts hold ts, host, severity, text. Each kind is capped first."""
    capped_parts = [df.orderBy("ts").limit(TIMELINE_CAPS.get(kind, TIMELINE_CAP)).select(F.lit(kind).alias("kind"), "ts", "host", "severity", "text") for kind, df in parts.items()]
    return union(capped_parts).orderBy("ts", "kind", "text").limit(TIMELINE_CAP)


def filter_timeline(events: DataFrame, host: str = "", kind: str = "", min_severity: str = "INFO") -> DataFrame:
    if host:
        events = events.where(F.contains("host", F.lit(host)))
    if kind:
        events = events.where(F.col("kind") == kind)
    return events.where(_map(SEVERITY_WEIGHT)[F.col("severity")] >= SEVERITY_WEIGHT[min_severity])
