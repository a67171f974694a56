"""Exact dedup by deterministic block naming.

The white-space-normalised UTF-8 text is cut into fixed-size blocks. Equal blocks are brought together by a
sort and get one integer name, then adjacent names are paired and the pairs named in turn, until each document
has a single name. Two documents have the same (block count, name) exactly when their texts are equal: names
come from comparing contents, no hash decides.

Scale: the block contents are shuffled once; later levels move two longs per block and halve each time. A block
that more than one in `heavy_share` of all blocks, or more than MOST_IN_TASK, equal (found by counting hashes) is named like
the pairs, so that its occurrences never meet in one task: names are a map-side combined minimum and joined back,
which Spark splits when a pair is skewed. Texts of one block, most of them, are through after the first naming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, load, stash, text_or_empty, with_row_id

BLOCK_BYTES = 2048
HEAVY_SHARE = 1000
#: Equal blocks that meet in one task at most, and hashes of more common ones that are broadcast at most (8 MB).
MOST_IN_TASK, MOST_HOT = 100_000, 1_000_000


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are one group. Of equal texts the row with the smallest doc_id stays
    (null ids last); among repeated rows of that id the first in the scan stays and the others have kept = false.
    Texts of any length are named block by block. Other columns are ignored. An empty table gives no rows.
    """
    norm = F.regexp_replace(text_or_empty(), SPACE, " ")
    rows = with_row_id(docs.select("doc_id", "text")).select("rid", "doc_id", norm.cast("binary").alias("bin"))
    count = "greatest(1L, (octet_length(bin) + {b} - 1) div {b})".format(b=block_bytes)
    blocks = (
        rows.withColumn("n", F.expr(count).cast("int"))
        .select(
            "rid",
            "n",
            F.struct("doc_id", F.sha2("bin", 256).alias("sha")).alias("doc"),
            F.expr(f"posexplode(transform(sequence(0, n - 1), i -> substring(bin, i * {block_bytes} + 1, {block_bytes})))").alias("pos", "block"),
        )
        .select("rid", "n", "pos", "block", F.when(F.col("pos") == 0, F.col("doc")).alias("doc"))
        .withColumn("occ", F.monotonically_increasing_id())
    )

    # blocks that are too common to meet in one task: their names are a map-side combined minimum, joined back
    raw = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    common = min(MOST_IN_TASK, max(heavy_share, (raw["rows"] + (raw["bytes"] or 0) // block_bytes) // heavy_share))
    hashed = blocks.withColumn("h", F.xxhash64("block"))
    hot = stash(hashed.groupBy(F.col("h").alias("hot")).count().where(F.col("count") > common).select("hot"), "hot")
    n_hot = hot.count()

    light = hashed
    if n_hot:
        hashed = hashed.join(F.broadcast(hot) if n_hot <= MOST_HOT else hot, F.col("h") == F.col("hot"), "left")
        light = hashed.where("hot IS NULL")
    named = light.withColumn("name", F.min("occ").over(Window.partitionBy("block"))).drop("block", "occ", "h", "hot")
    if n_hot:
        heavy = hashed.where("hot IS NOT NULL").drop("h", "hot")
        names = stash(heavy.groupBy("block").agg((-1 - F.min("occ")).alias("name")), "heavy").withColumnRenamed("block", "content")
        named = named.unionByName(heavy.join(names, F.col("block") == F.col("content")).drop("block", "content", "occ"))

    level = stash(_arrays(named, keep_doc=True), "names")
    docs_of = level.select("rid", "doc", "n")
    final = level.where("n = 1").select("rid", F.col("names")[0].alias("name"))
    level, length = level.where("n > 1").select("rid", "names"), level.agg(F.max("n")).first()[0] or 1
    while length > 1:
        level = stash(_pair_level(level), "names")
        final = final.unionByName(level.where(F.size("names") == 1).select("rid", F.col("names")[0].alias("name")))
        level, length = level.where(F.size("names") > 1), (length + 1) // 2

    ident = stash(docs_of.join(final, "rid").select("rid", "doc.doc_id", "doc.sha", "n", "name"), "identity")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = stash(ident.groupBy("n", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return ident.join(groups, ["n", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _arrays(named: DataFrame, keep_doc: bool = False) -> DataFrame:
    """The names of each row's blocks in order; a row's list is as long as its own text."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names")
    if keep_doc:
        return named.groupBy("rid").agg(F.first("doc", ignorenulls=True).alias("doc"), F.first("n").alias("n"), names)
    return named.groupBy("rid").agg(names)


def _pair_level(level: DataFrame) -> DataFrame:
    """Name the adjacent pairs; a last name without a partner is paired with null."""
    pairs = level.select(
        "rid",
        F.expr("posexplode(transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] AS a, get(names, 2 * i + 1) AS b)))").alias("pos", "pair"),
    ).select("rid", "pos", "pair.a", "pair.b", F.monotonically_increasing_id().alias("occ"))
    names = stash(pairs.groupBy("a", "b").agg(F.min("occ").alias("name")), "pairs").withColumnsRenamed({"a": "na", "b": "nb"})
    named = pairs.drop("occ").join(names, (F.col("a") == F.col("na")) & F.col("b").eqNullSafe(F.col("nb")))
    return _arrays(named.select("rid", "pos", "name"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
