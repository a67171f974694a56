"""Mixing sources to target weights with hash-threshold histograms.

Each row has a fixed 60-bit hash. For a source's budget the rows below some hash threshold are taken, so that a
smaller budget takes a subset of a larger one. The threshold is found from sums of words by source and hash
bucket; only the bucket in which the budget ends is summed again, by finer buckets, until it is a single hash.
Nothing is sorted and no row moves: the sums are map-side combined and the choice is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, load, stash, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
HASH_BITS, STEP_BITS = 60, 12
#: Sources whose plan is broadcast at most, some 50 bytes each.
MOST_BROADCAST = 200_000


def targets(totals: DataFrame, weights: Sequence[int], most_repeats: int = MOST_REPEATS) -> DataFrame:
    """totals(mix_source, size) with target, of 6 decimals: weight shares of all words, capped at most_repeats times the
    source's own words, the excess shared again by weight among the others.

    In the order of cap over weight the capped sources come first; the first one whose cap is no less than the level that
    is left for it gives the level of all that follow. One task sorts the sources, a few numbers each.
    """
    by_name, ratio = F.col("mix_source").asc_nulls_last(), F.col("cap") / F.col("weight")
    turn = F.pmod(F.row_number().over(Window.orderBy(by_name)) - 1, F.lit(len(weights))) + 1
    rows = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("cap", most_repeats * F.col("size"))
    before, every = Window.orderBy(ratio, by_name).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("ratio", ratio).withColumn("level", left.cast("double") / free)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("mix_source").isNull().alias("none"), "mix_source", "level"))).over(every)["level"]
    target = F.when(F.col("ratio") < level, F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("mix_source", "size", F.round(target, 6).alias("target"))


def _size():
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _hash():
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text_or_empty()))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _few(sources: DataFrame) -> DataFrame:
    """A table by source, broadcast if it is small."""
    return F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """mix_plan_source, source_size, target, mix_whole, mix_bound: each row of a source is taken mix_whole times, and once
    more if its hash is below mix_bound. sized: mix_source, mix_hash, size."""
    totals = stash(sized.groupBy("mix_source").agg(F.sum("size").alias("size")), "totals")
    whole = F.when(F.col("size") > 0, F.least(F.lit(most_repeats), F.floor(F.col("target") / F.col("size")).cast("int"))).otherwise(0)
    rest = F.when((F.col("size") > 0) & (F.col("whole") < most_repeats), F.round(F.col("target") - F.col("whole") * F.col("size"), 6)).otherwise(F.lit(0.0))
    table = stash(targets(totals, weights, most_repeats).withColumn("whole", whole).withColumn("rest", rest), "targets")
    bounds = _few(stash(_thresholds(sized, table), "bounds")).withColumnRenamed("mix_source", "s")
    joined = table.join(bounds, F.col("mix_source").eqNullSafe(F.col("s")), "left")
    return stash(joined.select(F.col("mix_source").alias("mix_plan_source"), F.col("size").alias("source_size"), "target", F.col("whole").alias("mix_whole"), F.col("bound").alias("mix_bound")), "plan")


def _repeats(mix_hash):
    return F.col("mix_whole") + F.coalesce(mix_hash < F.col("mix_bound"), F.lit(False)).cast("int")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken.

    size is the number of words (null: 0). Every row is taken target // source_size times and those below the
    source's threshold once more; the row at the threshold goes to the nearer side. Null is a source of its own, the
    last. Rows with the same doc_id and text have one hash and are taken alike. A source without words takes none.
    Texts of any length are counted whole; an empty table gives no rows. Other columns are ignored.
    """
    sized = stash(docs.select("doc_id", F.col("source").alias("mix_source"), _size().alias("size"), _hash().alias("mix_hash")), "sizes")
    joined = sized.join(_few(plan(sized, weights, most_repeats)), F.col("mix_source").eqNullSafe(F.col("mix_plan_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _repeats(F.col("mix_hash"))).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, as many times as it takes them; all columns stay. Nulls, ties, repeated rows and an
    empty table count as in mix."""
    sized = stash(docs.select(F.col("source").alias("mix_source"), _size().alias("size"), _hash().alias("mix_hash")), "sizes")
    chosen = plan(sized, weights, most_repeats).select("mix_plan_source", "mix_whole", "mix_bound")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # columns of any name stay apart from those of the plan
    rows = docs.select(own.alias("own"), F.col("source").alias("mix_source"), _hash().alias("mix_hash"))
    joined = rows.join(_few(chosen), F.col("mix_source").eqNullSafe(F.col("mix_plan_source")))
    return joined.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), _repeats(F.col("mix_hash"))))).select("own.*")


def _thresholds(sized: DataFrame, table: DataFrame) -> DataFrame:
    """mix_source, bound: rows with a hash below bound fill the rest of the source's budget."""
    # edge: start of the bucket in which the budget ends, used: words below that start
    edge = table.select("mix_source", "rest", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("used"))
    inside = Window.partitionBy("mix_source").orderBy("bucket")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        wide = shift + STEP_BITS
        e = _few(edge.select(F.col("mix_source").alias("s"), "rest", "edge", "used"))
        rows = sized.select("mix_source", "mix_hash", "size")
        if wide < HASH_BITS:
            same = F.col("mix_source").eqNullSafe(F.col("s")) & (F.shiftright("mix_hash", wide) == F.shiftright("edge", wide))
            rows = rows.join(e, same).select("mix_source", "mix_hash", "size")
        sums = rows.groupBy("mix_source", F.shiftright("mix_hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.join(e, F.col("mix_source").eqNullSafe(F.col("s"))).withColumn("after", F.col("used") + F.sum("words").over(inside))
        start = (F.col("after") - F.col("words")).alias("used")
        if shift:
            # the first bucket that the budget doesn't fill; none when it is spent by the last
            step = run.where(F.col("after") > F.col("rest")).groupBy("mix_source").agg(F.min(F.struct("bucket", start, "rest")).alias("b"))
            edge = stash(step.select("mix_source", "b.rest", F.shiftleft("b.bucket", shift).alias("edge"), "b.used"), "edges")
        else:
            # one hash a bucket: it is taken when that is nearer
            far = 2 * (F.col("after") - F.col("words")) + F.col("words") > 2 * F.col("rest")
            last = run.groupBy("mix_source").agg(F.min(F.when(far, F.col("bucket"))).alias("out"), F.max("bucket").alias("top"))
            return last.select("mix_source", F.coalesce("out", F.col("top") + 1).alias("bound"))
    raise AssertionError


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS total,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size / w AS ratio,
         total - coalesce(sum(3 * source_size) OVER a, 0) AS pool, sum(w) OVER () - coalesce(sum(w) OVER a, 0) AS free
  FROM s WINDOW a AS (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lam AS (
  SELECT pool::DOUBLE / free AS level FROM r WHERE pool::DOUBLE / free <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
         round(CASE WHEN ratio < (SELECT level FROM lam) THEN 3.0 * source_size ELSE w * (SELECT level FROM lam) END, 6) AS target
  FROM r
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS whole FROM t
), q AS (
  SELECT *, CASE WHEN source_size > 0 AND whole < 3 THEN round(target - whole * source_size, 6) ELSE 0 END AS rest FROM p
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       (size * (whole + CASE WHEN 2 * (upto - own) + own > 2 * rest THEN 0 ELSE 1 END))::BIGINT AS taken
FROM c
"""
