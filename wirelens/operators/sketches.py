"""Approximate aggregates as states that are kept by day and merged: distinct values, frequent values, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count, as a power of two (about 0.8 % at 14), and values that a state of frequent ones keeps.
HLL_BITS, TRACKED = 14, 1000


def sketch(rows: DataFrame, key: list[str], distinct: dict[str, Column] | None = None, frequent: dict[str, Column] | None = None, spread: dict[str, Column] | None = None) -> DataFrame:
    """One row per key with n and a state for each name: distinct values, frequent values, quantiles of doubles.

    A state's size is bounded whatever the number of rows, so a key that a third of all rows have costs no more than others;
    rows are aggregated before they are shuffled. Nulls are left out.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.hll_sketch_agg(c, F.lit(HLL_BITS)).alias(name) for name, c in (distinct or {}).items()]
    aggs += [F.expr(f"approx_top_k_accumulate(`{name}`, {TRACKED})").alias(name) for name in (frequent or {})]
    aggs += [F.kll_sketch_agg_double(c.cast("double")).alias(name) for name, c in (spread or {}).items()]
    return rows.withColumns({name: c for name, c in (frequent or {}).items()}).groupBy(*key).agg(*aggs)


def merged(states: DataFrame, key: list[str], distinct=(), frequent=(), spread=()) -> DataFrame:
    """States of parts, as of days, put together: what one state over all their rows holds, within the same bounds."""
    aggs = [F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in distinct], *[F.expr(f"approx_top_k_combine({c}, {TRACKED})").alias(c) for c in frequent], *[F.kll_merge_agg_double(c).alias(c) for c in spread]]
    return states.groupBy(*key).agg(*aggs)


def estimates(states: DataFrame, distinct=(), frequent=(), spread=(), top: int = 10, ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """What states say: numbers of distinct values, the `top` frequent values with their counts, quantiles at ranks."""
    at = F.array(*[F.lit(r) for r in ranks])
    changed = {c: F.hll_sketch_estimate(c) for c in distinct} | {c: F.expr(f"approx_top_k_estimate({c}, {top})") for c in frequent} | {c: F.kll_sketch_get_quantile_double(c, at) for c in spread}
    return states.withColumns(changed)
