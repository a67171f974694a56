"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import map_batches, sliced  # noqa: F401

#: The white space of every contract here, and its complement.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which driver and executors share.

    Where a local session, as in tests, has it unset, one temporary folder per session is used; a cluster must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wirelens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wirelens/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    Written files survive lost executors, and each later use reads them instead of computing df again.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bitmaps of 4 KiB that are broadcast at most: 16 MB.
MOST_BITMAPS = 4096


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of name_2, name_3 ... that is no column of df."""
    taken, k = {c.lower() for c in df.columns}, 1
    while (found := name if k == 1 else f"{name}_{k}").lower() in taken:
        k += 1
    return found


def rows_in(rows: DataFrame, name: str, rids: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose number in column `name` is in rids(rid), or is not.

    One bit a row tells: 32,768 row numbers have a bitmap of 4 KiB, and at most MOST_BITMAPS of them are broadcast, so
    that the rows stay where they are. Beyond that the numbers are joined.
    """
    bits = stash(rids.groupBy(F.shiftright("rid", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("rid").bitwiseAND(F.lit(32767))).alias("bits")), "bits")
    part, flags = free_name(rows, "rows_in_part"), free_name(rows, "rows_in_bits")
    if bits.count() > MOST_BITMAPS:
        return rows.join(rids.select(F.col("rid").alias(part)), F.col(name) == F.col(part), "left_semi" if inside else "left_anti")
    joined = rows.join(F.broadcast(bits.select(F.col("part").alias(part), F.col("bits").alias(flags))), F.shiftright(name, 15) == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(flags, F.shiftright(F.col(name).bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = F.coalesce(F.bit_get(byte, F.col(name).bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return joined.where(found if inside else ~found).select(*[F.col(f"`{c}`") for c in rows.columns])


_worker_copy: tuple = (None, None)


def worker_copy(build: Callable, *args):
    """build(*args), which a Python worker keeps for its next tasks. It keeps one such object: the former goes first."""
    global _worker_copy
    if _worker_copy[0] != (build, args):
        _worker_copy = (None, None)
        _worker_copy = ((build, args), build(*args))
    return _worker_copy[1]


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Number the rows with distinct longs, the same ones in every plan that starts from df.

    Over files read, projected and filtered the numbers follow from the file splits. Any other input is written first, since a
    recomputed shuffle may hand out its rows in another order.
    """
    if not df.inputFiles() or _reorders(df):
        df = stash(df, "rows")
    return df.withColumn(name, F.monotonically_increasing_id())


def _reorders(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+|-]*([A-Za-z]+)", line))}
    return not nodes <= {"Project", "Filter", "Relation", "MapInArrow", "MapInPandas"}
