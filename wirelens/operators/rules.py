"""Rule scans over text surfaces, and what is made of their hits."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.rules import Rule


HITS = "array<struct<rule:string,kind:string,confidence:string,score:int,value:string>>"


def scan(surfaces: DataFrame, rules: Iterable[Rule], column: str = "text") -> DataFrame:
    """A row for each hit: the other columns of surfaces, rule, kind, confidence, score, value. One pass over the text, and
    a pattern is tried only on texts that hold, in lower case, one of the literals that it needs."""
    low = "__low"

    def hits(r: Rule) -> Column:
        fixed = [F.lit(v).alias(n) for n, v in (("rule", r.id), ("kind", r.kind), ("confidence", r.confidence), ("score", r.score))]
        found = F.transform(F.regexp_extract_all(F.col(column), F.lit(r.java), F.lit(r.group)), lambda v: F.struct(*fixed, v.alias("value")))
        holds = [F.contains(F.col(low), F.lit(x)) for x in sorted(r.needs)]
        return F.when(reduce(Column.__or__, holds), found).otherwise(F.array().cast(HITS)) if holds else found

    others = [c for c in surfaces.columns if c != column]
    lowered = surfaces.withColumn(low, F.lower(column))
    return lowered.select(*others, F.explode(F.flatten(F.array(*map(hits, rules)))).alias("hit")).select(*others, "hit.*")


def distinct_hits(hits: DataFrame, order: list[str]) -> DataFrame:
    """The first hit of each kind and value, by the columns in order."""
    first = hits.groupBy("kind", "value").agg(F.min_by(F.struct(*[c for c in hits.columns if c not in ("kind", "value")]), F.struct(*order, "rule")).alias("h"))
    return first.select("kind", "value", "h.*")


def merge_hits(old: DataFrame, extra: DataFrame) -> DataFrame:
    """extra, and of old what extra doesn't have, high confidence first within a kind."""
    rest = old.join(extra.select("kind", "value"), ["kind", "value"], "left_anti")
    return extra.unionByName(rest).orderBy("kind", F.col("confidence") != "high", "value")


def masked(hits: DataFrame, reveal: bool = False) -> DataFrame:
    return hits if reveal else hits.withColumn("value", text.mask_secret(F.col("value")))


# Words and endings that raise a string's rank.
KEYWORDS = r"(?i)\b(password|passwd|pwd|secret|token|api[_\-]?key|flag|auth|credential|login|session|admin|root|private|key|bearer)\b"
EXTENSIONS = r"(?i)\.(?:zip|rar|7z|gz|tar|exe|dll|so|bin|php|asp|jsp|py|pl|sh|pdf|docx?|xlsx?|pptx?|csv|json|xml|conf|cfg|ini|env|pem|key|pcap)$"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def string_score(s: Column) -> Column:
    """Rank of a printable string: its length, words, look of encoded data, markup, addresses."""
    encoded = s.rlike("^[A-Za-z0-9+/=]{16,}$") | s.rlike("^[0-9a-fA-F]{16,}$")
    return (
        F.floor(F.least(F.length(s), F.lit(60)) / 6)
        + F.when(s.rlike(KEYWORDS), 25).otherwise(0)
        + F.when(s.rlike(EXTENSIONS), 10).otherwise(0)
        + F.when(encoded, F.floor(text.entropy(s) * 4)).otherwise(0)
        + F.when(F.ltrim(s).startswith("<"), 8).otherwise(0)
        + F.when(s.rlike(EMAIL), 12).otherwise(0)
        + F.when(s.rlike("^(?:https?|ftp)://"), 10).otherwise(0)
    ).cast("long")


def printable_strings(surfaces: DataFrame, column: str = "text", least: int = 6) -> DataFrame:
    """Distinct runs of printable ASCII of a surface, with their score."""
    others = [c for c in surfaces.columns if c != column]
    runs = surfaces.select(*others, F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0)))).alias("value"))
    return runs.withColumn("score", string_score(F.col("value")))


def top_strings(strings: DataFrame, key: str, n: int = 25) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "value")
    return strings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
