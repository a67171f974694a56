"""Embedding whitening by tiled covariance.

Vectors become whole numbers; the distinct ones are the fit list. Its rows are cut into row-blocks and its dimensions
into column blocks. Column blocks are shuffled by row-block and met in pairs, one pair for each tile of dimension
pairs; a task multiplies the centred blocks and keeps one sum per tile, and the sums of a tile are shuffled by tile.
The assembled matrix is as large as the dimensions squared, whatever the number of rows, and is decomposed on the
driver. Whitening is then a projection of each row.

Scale: the fit list is shuffled once to find distinct vectors (combined on the map side, so a vector that a third of
all rows share is one row a task), and once as column blocks of the narrowest integer type.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_batches, stash

SCALE, COMPONENTS = 256, 4
#: Rows of a row-block, dimensions of a column block, and sums that a task holds at a time.
BLOCK_ROWS, TILE, MOST_TILES = 4096, 32, 256

BLOCKS = "row_block long, col_block int, n_rows int, kind string, payload binary"
TILES = "left_block int, right_block int, payload binary"
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x, floor(scale * entry) as longs, of the rows whose embedding is neither null nor holds a null, a NaN or
    an infinite entry. Products beyond a long are the nearest long. Shorter vectors are filled up with zeros."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & F.forall("e", lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))))
    least, most = rows.agg(F.min(F.size("e")), F.max(F.size("e"))).first()
    x = F.transform("e", lambda c: F.floor(c * scale))
    if least != most:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("e")))
    return rows.select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _reach(x: np.ndarray) -> int:
    """The largest absolute entry."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows of fit(x) and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            total += (x if _reach(x) * max(len(x), 1) < 1 << 62 else x.astype(object)).sum(axis=0).astype(object)
        if n:
            cols = [pa.array(range(d), pa.int32()), pa.array([decimal.Decimal(int(t)) for t in total], pa.decimal128(38, 0)), pa.array([n] * d, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "total", "n"])

    parts = map_batches(fit.select("x"), run, "dim int, total decimal(38,0), n long")
    found = parts.groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row a dimension
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def column_blocks(fit: DataFrame, d: int, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """The rows of fit(x), read from files, as row-blocks cut into column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part, k = TaskContext.get().partitionId(), 0

        def cut(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            for c in range(0, d, tile):
                block = np.ascontiguousarray(x[:, c : c + tile])
                kind = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or _reach(block) < 1 << (8 * int(t[2]) - 1))
                row = {"row_block": (part << 32) + k, "col_block": c // tile, "n_rows": len(x), "kind": kind, "payload": block.astype(kind).tobytes()}
                yield pa.RecordBatch.from_pylist([row], _BLOCK_TYPES)

        for batch in batches:
            held.append(_matrix(batch.column(0), d))
            while sum(map(len, held)) >= block_rows:
                x = np.concatenate(held)
                yield from cut(x[:block_rows])
                held, k = [x[block_rows:]], k + 1
        if sum(map(len, held)):
            yield from cut(np.concatenate(held))

    return map_batches(fit.select("x"), run, BLOCKS)


_BLOCK_TYPES = pa.schema([("row_block", pa.int64()), ("col_block", pa.int32()), ("n_rows", pa.int32()), ("kind", pa.string()), ("payload", pa.binary())])
_TILE_TYPES = pa.schema([("left_block", pa.int32()), ("right_block", pa.int32()), ("payload", pa.binary())])


def _summed(products: Iterator[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Products summed by tile; where a task meets more than MOST_TILES tiles, in several rows a tile."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (p, q), total in held.items():
            yield pa.RecordBatch.from_pylist([{"left_block": p, "right_block": q, "payload": total.tobytes()}], _TILE_TYPES)
        held.clear()

    for p, q, product in products:
        if (p, q) not in held and len(held) == MOST_TILES:
            yield from flush()
        held[p, q] = held[p, q] + product if (p, q) in held else product
    yield from flush()


def tile_sums(blocks: DataFrame, mean: np.ndarray, tile: int = TILE) -> DataFrame:
    """left_block, right_block, payload: for each pair of column blocks the sum of their centred products."""
    names = ("col_block", "kind", "payload")
    left = blocks.select("row_block", "n_rows", *[F.col(c).alias(f"left_{c}") for c in names])
    right = blocks.select(F.col("row_block").alias("same_rows"), *[F.col(c).alias(f"right_{c}") for c in names])
    pairs = left.join(right, (F.col("row_block") == F.col("same_rows")) & (F.col("left_col_block") <= F.col("right_col_block"))).drop("row_block", "same_rows")

    def centred(row: dict, side: str) -> np.ndarray:
        a = row[f"{side}_col_block"] * tile
        x = np.frombuffer(row[f"{side}_payload"], row[f"{side}_kind"]).reshape(row["n_rows"], -1)
        return x - mean[a : a + tile]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        return _summed((r["left_col_block"], r["right_col_block"], centred(r, "left").T @ centred(r, "right")) for r in rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        return _summed((r["left_block"], r["right_block"], np.frombuffer(r["payload"])) for r in rows)

    return map_batches(map_batches(pairs, multiply, TILES).repartition("left_block", "right_block"), add, TILES)


def covariance(fit: DataFrame, d: int, n: int, mean: np.ndarray, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> np.ndarray:
    """The covariance of fit(x), divisor n, assembled from its tiles."""
    out = np.zeros((d, d))
    for row in tile_sums(column_blocks(fit, d, block_rows, tile), mean, tile).toLocalIterator():
        a, b = row["left_block"] * tile, row["right_block"] * tile
        out[a : a + tile, b : b + tile] += np.frombuffer(row["payload"]).reshape(min(tile, d - a), -1)
    for a in range(0, d, tile):
        out[a + tile :, a : a + tile] = out[a : a + tile, a + tile :].T
    return (out + out.T) / (2 * n)


def principal(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; a vector's largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    signs = np.sign(u[np.abs(u).argmax(axis=0), range(u.shape[1])])
    return e, u * signs


def _whitener(mean: np.ndarray, e: np.ndarray, u: np.ndarray, floor: float):
    """x -> whitened rows; NaN in the columns of components without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(e > floor, u / np.sqrt(np.where(e > floor, e, 1.0)), np.nan)
    return lambda x: (x - mean) @ scaled


def _deviations(x: np.ndarray, n: int, total: list[int], d: int) -> list[int | None]:
    """The sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
    if d * (n * _reach(x) + max(map(abs, total))) ** 2 < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, block_rows: int = BLOCK_ROWS, tile: int = TILE) -> DataFrame:
    """A row for each usable row of vectors(vec_id, embedding) and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Rows whose embedding is null or holds a null or non-finite entry are dropped. Repeated rows each get their rows but are one
    vector of the fit list; vec_id may be null. Vectors shorter than the longest are filled up with zeros; empty ones alone, as an
    empty table, give no rows. Components are at most the dimensions; where one has no variance (as all have with a single
    vector), whitened is null and explained 0. Equal eigenvalues leave their order and axes open. deviation is null beyond a
    long. Other columns are ignored.
    """
    rows = whole_vectors(vectors, scale)
    fit = stash(rows.select("x").distinct(), "fit")
    first = fit.select(F.size("x")).first()
    d = first[0] if first else 0
    if not d:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    n, total = sums(fit, d)
    mean = np.array([t / n for t in total])
    v = covariance(fit, d, n, mean, block_rows, tile)
    e, u = principal(v, min(components, d))
    trace, floor = float(v.trace()), float(v.trace()) * d * np.finfo(float).eps
    whitened = _whitener(mean, e, u, floor)
    live = [c for c in range(len(e)) if e[c] > floor]
    error = identity_error(fit, d, whitened, live)
    explained = [float(e[c] / trace) if c in live else 0.0 for c in range(len(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            w = whitened(x).ravel()
            cols = [
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                pa.array(_deviations(x, n, total, d), pa.int64()).take(pa.array(each)), pa.array(w, mask=np.isnan(w)), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_batches(rows, run, WHITENED)


def identity_error(fit: DataFrame, d: int, whitened, live: list[int]) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over the components with variance."""
    if not live:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = whitened(_matrix(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[:, c])) for c in live], [f"w{c}" for c in live])

    w = map_batches(fit.select("x"), run, ", ".join(f"w{c} double" for c in live))
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = w.agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(load(spark, sf_dir, "embeddings"))
