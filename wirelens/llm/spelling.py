"""Spelling variant grouping by two-dimensional range reporting.

Two words differ by one replaced code point at position i if they share the first i code points and all from i + 1 on; by
one inserted there if the longer one shares the first i and all behind. Words sorted forwards put the first condition
into an interval, words sorted from their ends the second. A wavelet tree over the ranks in reverse order, laid out in
forward order, reports the points of both intervals, for all words of one edit position at a time.

Scale: an index never holds the whole lexicon. A pair whose edit lies in the second half of a word shares the first
half, else the second half, so words are shuffled by (length, half) and each task indexes whole groups, some thousand
rows at a time. A group of more than MOST_GROUP words is split at the middle of its edit interval: either part shares
more of the word. An interval of one position leaves a group as large as the alphabet, so any group comes down. Each
pair is reported in exactly one group. Counting words is combined in tasks and on the map side.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_batches, sliced, stash, text_or_empty

# What a run is, and which runs lose a code point.
RUN = re.compile("[a-zÀ-ÿ]+")
EVERY = 199
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Characters of a text that are split at a time; words that a task counts before it hands them on.
PIECE, MOST_WORDS = 1 << 20, 200_000
#: Words of a group that is indexed whole, and bytes of the words that are indexed together.
MOST_GROUP, CHUNK_BYTES = 50_000, 1 << 20


# -- words ------------------------------------------------------------------------------------------------------------


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of a text, A-Z in lower case, of about PIECE characters at a time."""
    start = 0
    while start < len(text):
        end = min(start + PIECE, len(text))
        if end < len(text):  # not within a run
            end = next((k for k in range(end, len(text)) if not RUN.match(text[k].lower() if text[k].isascii() else text[k])), len(text))
        yield RUN.findall(text[start:end].encode().lower().decode())  # bytes.lower() is of ASCII alone
        start = end


def word_counts(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS) -> DataFrame:
    """word, n over all of docs(doc_id, text), of words of least_chars code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if n and len(w) >= least_chars]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in sliced(batches):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                prefix = zlib.crc32(f"{name}:".encode())
                for runs in _runs(text.as_py()):
                    total.update(runs)
                    crc = np.fromiter(map(zlib.crc32, " ".join(runs).encode().split(b" "), repeat(prefix)), np.uint32, len(runs)) if runs else np.zeros(0, np.uint32)
                    for k in np.flatnonzero(crc % every == 0).tolist():
                        w, at = runs[k], int(crc[k]) % len(runs[k])
                        total[w] -= 1
                        total[w[:at] + w[at + 1 :]] += 1
                if len(total) > MOST_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    return map_batches(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# -- groups that share all but an interval of edit positions ------------------------------------------------------------


def edit_groups(lexicon: DataFrame, least_chars: int = LEAST_CHARS, most_group: int = MOST_GROUP) -> DataFrame:
    """word, n, size, low, high, key of lexicon(word, n).

    Words of `size` code points, and those of one more, are in a group if they can differ by an edit at a position from
    low to high - 1 alone, counted in the shorter word.
    """
    halves = "array(struct(m AS size, 0 AS low, m div 2 AS high), struct(m AS size, m div 2 AS low, m + 1 AS high)"
    halves += ", struct(m - 1 AS size, 0 AS low, (m - 1) div 2 AS high), struct(m - 1 AS size, (m - 1) div 2 AS low, m AS high))"
    rows = lexicon.selectExpr("word", "n", "length(word) AS m").selectExpr("word", "n", "m", f"inline({halves})").where(f"size >= {least_chars}")
    # the longer word's shared end starts one later
    key = "xxhash64(size, low, high, substring(word, 1, low), substring(word, high + 1 + m - size)) AS key"
    rows = rows.selectExpr("word", "n", "m", "CAST(size AS INT) AS size", "CAST(low AS INT) AS low", "CAST(high AS INT) AS high").selectExpr("*", key)
    done = None
    while True:
        large = rows.groupBy("size", "low", "high", "key").agg(F.count(F.lit(1)).alias("c")).where(f"c > {most_group} AND high - low > 1")
        large = stash(large.selectExpr("key AS large", "low AS large_low", "high AS large_high", "size AS large_size"), "large")
        if large.isEmpty():
            return (rows if done is None else done.unionByName(rows)).drop("m")
        same = (F.col("key") == F.col("large")) & (F.col("low") == F.col("large_low")) & (F.col("high") == F.col("large_high")) & (F.col("size") == F.col("large_size"))
        small = rows.join(large, same, "left_anti")
        done = small if done is None else done.unionByName(small)
        parts = "inline(array(struct(low AS a, (low + high) div 2 AS b), struct((low + high) div 2 AS a, high AS b)))"
        cut = rows.join(large, same, "left_semi").selectExpr("word", "n", "m", "size", parts).selectExpr("word", "n", "m", "size", "CAST(a AS INT) AS low", "CAST(b AS INT) AS high")
        rows = stash(cut.selectExpr("*", key), "groups")


# -- range reporting ------------------------------------------------------------------------------------------------------


class WaveletTree:
    """A permutation by the bits of its values, from the highest; at each level, zeros are kept before ones."""

    def __init__(self, values: np.ndarray) -> None:
        self.depth = max(1, int(len(values) - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        for level in range(self.depth - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            before = np.zeros(len(values) + 1, np.int64)  # ones before each place
            np.cumsum(ones, out=before[1:])
            self.levels.append((before, len(values) - int(before[-1])))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value from low to high - 1 at the places from start to end - 1."""
        query = np.flatnonzero((start < end) & (low < high))
        start, end, base = start[query], end[query], np.zeros(len(query), np.int64)
        for k, (before, zeros) in enumerate(self.levels):
            half = 1 << (self.depth - 1 - k)
            s1, e1 = before[start], before[end]
            left, right = (start - s1, end - e1, base), (zeros + s1, zeros + e1, base + half)
            keep0 = (left[0] < left[1]) & (base < high[query]) & (base + half > low[query])
            keep1 = (right[0] < right[1]) & (right[2] < high[query]) & (right[2] + half > low[query])
            start, end, base = (np.concatenate((a[keep0], b[keep1])) for a, b in zip(left, right))
            query = np.concatenate((query[keep0], query[keep1]))
        return query, base


class TwoOrders:
    """Words sorted forwards and from their ends, and the tree that joins both orders."""

    def __init__(self, words: list[bytes], width: int) -> None:
        ends = [w[::-1] for w in words]
        self.rank, self.lcp = [], []
        self.order = []
        for one in (words, ends):
            flat = np.array(one, f"S{width}")
            order = np.argsort(flat, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            chars = flat[order].view(np.uint8).reshape(-1, width)
            lcp = np.zeros(len(order), np.int64)
            if len(order) > 1:
                lcp[1:] = (chars[1:] != chars[:-1]).argmax(axis=1)
            self.order.append(order)
            self.rank.append(rank)
            self.lcp.append(lcp)
        self.tree = WaveletTree(self.rank[1][self.order[0]])

    def _interval(self, side: int, shared: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words `of` the places, in one order, of the words with the same `shared` code points."""
        first = self.lcp[side] < shared
        first[0] = True
        starts = np.flatnonzero(first)
        group = np.cumsum(first)[self.rank[side][of]] - 1
        return starts[group], np.append(starts[1:], len(first))[group]

    def sharing(self, head: int, tail: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word of `of`, other word) for all that share `head` code points at the start and `tail` at the end, themselves left out."""
        start, end = self._interval(0, head, of)
        low, high = self._interval(1, tail, of)
        open_ = (end - start > 1) & (high - low > 1)  # else the word is alone
        q, value = self.tree.report(start[open_], end[open_], low[open_], high[open_])
        a, b = of[open_][q], self.order[1][value]
        return a[a != b], b[a != b]


def near_pairs(words: list[bytes], size: int, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shorter or equal word, near word) for edits at positions low to high - 1: each replacement both ways, each insertion once,
    at the last place where it can be."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(lengths == size)
    if not len(short):
        return
    if len(short) > 1:
        same = TwoOrders([words[k] for k in short], size)
        for i in range(low, min(high, size)):
            a, b = same.sharing(i, size - i - 1, np.arange(len(short)))
            yield short[a], short[b]
    if len(short) < len(words):
        both = TwoOrders(words, size + 1)
        chars = np.array(words, f"S{size + 1}").view(np.uint8).reshape(-1, size + 1)
        for i in range(low, min(high, size + 1)):
            a, b = both.sharing(i, size - i, short)
            last = (lengths[b] == size + 1) & (chars[a, i] != chars[b, i])
            yield a[last], b[last]


def near_words(lexicon: DataFrame, least_chars: int = LEAST_CHARS, most_group: int = MOST_GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """word, near, near_n: each ordered pair of words of lexicon(word, n) that differ by one edit, once."""

    def search(held: list[tuple], size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        words, counts, keys = (np.concatenate(x) for x in zip(*held))
        fresh = np.append(True, keys[1:] != keys[:-1])
        alone = np.bincount(np.cumsum(fresh) - 1) == 1
        keep = ~alone[np.cumsum(fresh) - 1]
        words, counts = words[keep], counts[keep]
        coded = [w.encode("latin-1") for w in words]
        for a, b in near_pairs(coded, size, low, high) if len(coded) else ():
            longer = np.fromiter((len(coded[k]) > size for k in b), bool, len(b))
            x, y = np.concatenate((a, b[longer])), np.concatenate((b, a[longer]))  # an insertion, and the deletion back
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(words[x], pa.string()), pa.array(words[y], pa.string()), pa.array(counts[y], pa.int64())], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, last, of = 0, None, None
        for batch in batches:
            words, counts = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            keys, sizes, lows, highs = (batch.column(c).to_numpy() for c in ("key", "size", "low", "high"))
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1]) | (lows[1:] != lows[:-1]) | (highs[1:] != highs[:-1])))
            ends = np.append(new[1:], len(keys))
            at = 0
            while at < len(new):
                s = new[at]
                now = (int(sizes[s]), int(lows[s]), int(highs[s]))
                if held and (now != of or keys[s] != last and rows * now[0] >= chunk_bytes):
                    yield from search(held, *of)
                    held, rows = [], 0
                of = now
                # as many whole groups of this interval as fit
                more = max(s + 1, s + max(0, chunk_bytes // now[0] - rows))
                upto = max(at + 1, int(np.searchsorted(ends, more, "right")))
                classes = np.flatnonzero((sizes[new[at:upto]] != now[0]) | (lows[new[at:upto]] != now[1]) | (highs[new[at:upto]] != now[2]))
                upto = at + int(classes[0]) if len(classes) else upto
                e = ends[upto - 1]
                held.append((words[s:e], counts[s:e], keys[s:e]))
                rows, last, at = rows + int(e - s), keys[e - 1], upto
        if held:
            yield from search(held, *of)

    groups = edit_groups(lexicon, least_chars, most_group)
    dealt = groups.repartition("size", "low", "high", "key").sortWithinPartitions("size", "low", "high", "key")
    return map_batches(dealt.select("word", "n", "size", "low", "high", "key"), run, "word string, near string, near_n long")


# -- forms ------------------------------------------------------------------------------------------------------------


def _roots(links: DataFrame) -> DataFrame:
    """word, root of links(word, form): the end of each word's chain of forms. A form is at least RATIO times as frequent, so
    chains are short, and each round doubles the steps taken."""
    at = stash(links.selectExpr("word", "form AS root"), "roots")
    while True:
        step = at.selectExpr("word AS next_word", "root AS next_root")
        joined = stash(at.join(step, F.col("root") == F.col("next_word"), "left").selectExpr("word", "coalesce(next_root, root) AS root", "next_root IS NOT NULL AS moved"), "roots")
        at = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY, most_group: int = MOST_GROUP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per word of docs(doc_id, text): word, form, root, n, n_near, form_n.

    Words are the runs of letters, A-Z lower-cased; of one run in `every`, told by a checksum of doc_id and run, a code point
    is deleted. Words of fewer than least_chars code points or least_count occurrences are left out. The form is the near word
    (one edit away) of most occurrences if it has `ratio` times the word's or more, ties by code points. Null texts, and
    empty ones, have no words; a null doc_id counts as an empty one. Repeated rows count as often as they occur. Texts and
    runs of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    lexicon = stash(word_counts(docs, every, least_chars).where(F.col("n") >= least_count), "lexicon")
    near = near_words(lexicon, least_chars, most_group, chunk_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = near.select(F.col("word").alias("of"), "n_near", F.col("best.near").alias("best"), (-F.col("best.less")).alias("best_n"))
    joined = lexicon.join(near, F.col("word") == F.col("of"), "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    forms = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(forms.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return forms.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(load(spark, sf_dir, "documents"))
