"""Benchmark decontamination by greedy string tiling.

Shared runs of SEED_TOKENS tokens, found by a rolling Karp-Rabin hash, join a document with benchmark items. For
each such pair the longest match that covers nothing marked yet is marked, again and again, down to the seed
length. The share of the item's tokens that are marked decides, so a passage is caught in whatever order its
parts appear.

Scale: the documents are scanned where they lie; the benchmark, the stated query set, is sent to the tasks in
blocks of about BLOCK_BYTES of text, one scan of the documents for each block, and a Python worker keeps the index of
one block (some 30 MB). No shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_batches, sliced, text_or_empty, worker_copy

SEED_TOKENS, MIN_COVERAGE = 4, 0.6
BLOCK_BYTES = 4 << 20
TOKEN = re.compile(r"\w+")
PIECE = 1 << 20


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Rolling:
    """Karp-Rabin hashes modulo 2**64 of the windows of ids, of any length, from one running sum."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64)))) for base in (_BASE, _BACK))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _BASE * down[:n])))

    def windows(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of k ids at the places `at`, or at all."""
        at = np.arange(max(0, len(self.sums) - k)) if at is None else at
        return (self.sums[at + k] - self.sums[at]) * self.up[at]


def _free_windows(taken: np.ndarray, k: int) -> np.ndarray:
    """Places of the windows of k ids of which none is taken."""
    before = np.concatenate(([0], np.cumsum(taken)))
    return np.flatnonzero(before[k:] == before[:-k]) if len(taken) >= k else np.empty(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc position, item position, length), longest first, of at least so many ids; 0 in doc matches nothing.

    The longest match of what isn't marked is found by bisection over its length, and all matches of that length are
    marked in the order of their places, as far as they don't overlap; then the next length. A document that
    repeats itself costs no more than its length for each round.
    """
    rolls = Rolling(doc), Rolling(item)
    taken = doc == 0, np.zeros(len(item), bool)

    def shared(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the free windows of k ids that both have."""
        places = [_free_windows(t, k) for t in taken]
        hashes = [r.windows(k, at) for r, at in zip(rolls, places)]
        inside = np.isin(hashes[0], hashes[1])
        return places[0][inside], hashes[0][inside], places[1], hashes[1]

    found, longest = [], min(len(doc), len(item))
    while longest >= least:
        low, high = least - 1, longest  # matches of low exist, of more than high don't
        while low < high:
            k = (low + high + 1) // 2
            low, high = (k, high) if len(shared(k)[0]) else (low, k - 1)
        if low < least:
            break
        at_doc, h_doc, at_item, h_item = shared(low)
        waiting: dict[int, deque[int]] = {}
        for q, h in zip(at_item.tolist(), h_item.tolist()):
            waiting.setdefault(h, deque()).append(q)
        for p, h in zip(at_doc.tolist(), h_doc.tolist()):
            places = waiting[h]
            while places and taken[1][places[0] : places[0] + low].any():
                places.popleft()
            if places and not taken[0][p : p + low].any() and np.array_equal(doc[p : p + low], item[places[0] : places[0] + low]):
                q = places.popleft()
                found.append((p, q, low))
                taken[0][p : p + low] = taken[1][q : q + low] = True
        longest = low - 1
    return found


class Index:
    """The seeds of a block of benchmark items: for each run of k ids its hash and place, in the order of hashes."""

    def __init__(self, items: tuple[tuple[int, str], ...], k: int) -> None:
        self.k, self.vocabulary = k, {}
        self.names, ids = [], []
        for item_id, text in items:
            if words := tokens(text):
                self.names.append(item_id)
                ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.length = np.array(list(map(len, ids)), np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.item = np.repeat(np.arange(len(ids)), self.length)
        rolling = Rolling(self.ids)
        self.seeds = {}
        for size in {min(k, n) for n in self.length.tolist()}:  # an item that is shorter than a seed is one
            chosen = self.length >= k if size == k else self.length == size
            place = np.flatnonzero(chosen[self.item] & (np.arange(len(self.ids)) + size <= (self.start + self.length)[self.item]))
            h = rolling.windows(size, place)
            order = np.argsort(h, kind="stable")
            self.seeds[size] = h[order], place[order]

    def matches(self, text: str, min_coverage: float) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, tokens marked) of each item that the text covers to min_coverage."""
        if not self.seeds:
            return []
        get, parts = self.vocabulary.get, []
        for start, end in _pieces(text):
            words = tokens(text[start:end])
            parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        rolling, out = None, []
        for size, (hashes, place) in self.seeds.items():
            at = _free_windows(ids == 0, size)
            if not len(at):
                continue
            rolling = rolling or Rolling(ids)
            h = rolling.windows(size, at)
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at, h = at[hashes[near] == h], h[hashes[near] == h]
            if len(at):
                out += self._tiled(ids, size, at, h, hashes, place, min_coverage)
        return sorted(out)

    def _tiled(self, ids, size, at, h, hashes, place, min_coverage) -> list[tuple[int, float, int, int]]:
        # what the document's seeds cover of each item, whatever their order
        known = np.unique(h)
        low, high = np.searchsorted(hashes, known), np.searchsorted(hashes, known, side="right")
        n = high - low
        hit = place[np.repeat(high - np.cumsum(n), n) + np.arange(n.sum())]
        covered = np.unique((hit[:, None] + np.arange(size)).ravel())
        items, counts = np.unique(self.item[covered], return_counts=True)
        out = []
        for k in items[counts >= min_coverage * self.length[items]].tolist():
            item = self.ids[self.start[k] : self.start[k] + self.length[k]]
            mine = at[np.isin(h, Rolling(item).windows(size))]
            # the parts of the document that share seeds with the item, a zero between them
            inside = np.unique((mine[:, None] + np.arange(size)).ravel())
            part = np.insert(ids[inside], np.flatnonzero(np.diff(inside) > 1) + 1, 0)
            found = tiles(part, item, size)
            marked = sum(t[2] for t in found)
            if marked >= min_coverage * len(item):
                out.append((self.names[k], marked / len(item), len(found), marked))
        return out


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield start, end
        start = end


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Broadcast]:
    """The items of benchmark(item_id, text) in broadcasts of about block_bytes of text each."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(tuple(tuple(r) for r in block))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed_tokens: int = SEED_TOKENS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """A row for each document and item it covers: doc_id, item_id, coverage, tiles, marked.

    Null and empty texts match nothing. An item of fewer than seed_tokens words is matched whole. Texts of any length
    and that repeat themselves are scanned whole, in time linear in their length for each tile length. Repeated rows of
    docs and repeated items are reported for each row; of equally long matches the first in the document counts, with the
    first place in the item. An empty table of either gives no rows. Other columns are ignored.
    """

    def scan(items: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = worker_copy(Index, items.value, seed_tokens)
            for batch in sliced(batches):
                rows = [(d, *m) for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for m in index.matches(x, min_coverage)]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "item_id", "coverage", "tiles", "marked"])

        return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, schema)

    schema = "doc_id long, item_id long, coverage double, tiles int, marked int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in benchmark_blocks(benchmark):
        out = out.unionByName(scan(items))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed_tokens: int = SEED_TOKENS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of docs that cover no item; all columns stay.

    Null and empty texts cover none. Repeated rows are judged alike; texts of any length are read whole; without documents there are
    no rows, without items all stay.
    """
    for items in benchmark_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = worker_copy(Index, items.value, seed_tokens)
            for batch in sliced(batches):
                yield batch.filter(pa.array([not index.matches(x or "", min_coverage) for x in batch.column("text").to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
