"""Sharding by weighted rendezvous hashing.

Each record goes to the shard with the best score of hash(record key, shard) under the shard's weight. A new
shard can only take records for which it now scores best, so nothing moves between the old ones. The choice is a
projection: no shuffle. It is written once, a few longs a row, and only the gapless slot numbers shuffle it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, stash, text_or_empty, with_row_id

N_SHARDS = 40
#: Rows of one (shard, bucket) that are numbered together, at most on average; and the most buckets a shard has.
ROWS_A_BUCKET = 1_000_000
MOST_BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard in 0..len(weights)-1 with the smallest -ln(u) / weight, u in (0, 1) from hash(key, shard)."""
    w = F.array(*[F.lit(float(x)) for x in weights])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s), 11).cast("double") + 0.5) / float(2**53)
        return F.struct((-F.log(u) / F.element_at(w, s + 1)).alias("score"), s.alias("shard"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["shard"]


def shard(docs: DataFrame, weights: Sequence[float] = (1.0,) * N_SHARDS, new_weight: float = 1.0) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The stable key is doc_id; all rows of one id, and all rows with null id, share a shard. size is the UTF-8
    bytes of the text (none for null) plus 16. slot counts a shard's rows from 0 without gaps; repeated rows have
    slots of their own. grown_shard is the shard when one of new_weight is added. Other columns are ignored.
    """
    keyed = with_row_id(docs.select("doc_id", "text")).select(
        "rid",
        "doc_id",
        (F.octet_length(text_or_empty()).cast("long") + 16).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, new_weight]).alias("grown_shard"),
    )
    keyed = stash(keyed, "shards")  # narrow, and each score is computed once
    buckets = min(MOST_BUCKETS, max(64, keyed.count() // (len(weights) * ROWS_A_BUCKET)))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    counts = keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "rid")
    numbered = keyed.withColumn("rank", F.row_number().over(inside) - 1)
    # offsets has at most len(weights) * MOST_BUCKETS rows of 24 bytes
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("rank") + F.col("offset")).alias("slot"), "grown_shard"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))
