"""Gapless numbers and running sums without a window over all rows of a key.

Rows are put into buckets of their place in the order; a bucket's own numbers come from a window over that bucket, and what
lies before it from a running sum over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(rows: DataFrame, key: list[str], at: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the rows of the same key up to and with the row itself.

    at, a time in seconds, must be the first column of the order; each second is a bucket. Nulls come first. Only narrow rows
    should be given: what else belongs to them is joined after.
    """
    named = {f"__{n}": c for n, c in sums.items()}
    rows = rows.withColumns({"__bucket": F.coalesce(F.floor(at), F.lit(-(1 << 62))), **named})
    own = Window.partitionBy(*key, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy(*key, "__bucket").agg(*[F.sum(n).alias(n) for n in named])
    buckets = buckets.select(*key, "__bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in named])
    joined = rows.join(buckets, [*key, "__bucket"])
    return joined.withColumns({n: F.col(f"__{n}_before") + F.sum(f"__{n}").over(own) for n in sums}).drop("__bucket", *named, *[f"{n}_before" for n in named])
