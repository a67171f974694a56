"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint holds, bit by bit, the majority over the XXH64 hashes of a document's word shingles. Two
fingerprints with at most three differing bits must have, on the ring of four 16-bit segments, a start from
which every chain of l segments differs in at most l * 3/4 bits: none in the first, one in two, two in three.
Rows are brought together by an equal first segment; where that bucket is large, also by the second segment with
one bit masked out (the one that may differ). In a bucket the chain is followed segment by segment, and only
pairs that pass get the full Hamming check.

Scale: each distinct fingerprint makes 4 rows of two longs, or up to 64 at depth two, where a key has 31 bits.
A task keeps a bounded forest of the links it has seen, so a cloud of n alike fingerprints gives about n links, not n * n.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, load, map_batches, rows_in, sliced, stash, text_or_empty, with_row_id
from .components import components

SEED, MAX_BITS, SEGMENTS = 42, 3, 4
SHINGLE_WORDS = 3
#: A bucket of one equal segment beyond this is split by the second segment.
LARGE_BUCKET = 256
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def word_pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of data in lists of about a megabyte, so that long texts need no list of all words."""
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > PIECE and (m := _SPACE.search(data, start + PIECE)):
            end = m.start()
        yield data[start:end].split()
        start = end


def fingerprint(data: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit majority fingerprint of UTF-8 text; zero without words."""
    digest, counts, n, tail = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    for words in word_pieces(data.translate(_LOWER)):
        tail += words
        if len(tail) < shingle:
            continue
        joined, lengths = b" ".join(tail), np.fromiter(map(len, tail), np.int64, len(tail))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[: len(tail) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
        n += len(starts)
        counts += _count_bits(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]))
        tail = tail[len(tail) - shingle + 1 :] if shingle > 1 else []
    if not n and tail:
        n, counts = 1, _count_bits(digest(b" ".join(tail), SEED))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def _count_bits(digests: bytes) -> np.ndarray:
    table = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(table[:, k], minlength=256) @ _BITS for k in range(8)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (signed long) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("data")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("data"))
    return map_batches(rows, run, "doc_id long, fp long")


class Forest:
    """Union-find over the fingerprints linked so far in a task; add() tells whether a link is new."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _segment(x: np.ndarray, k) -> np.ndarray:
    return (x >> (16 * (k % SEGMENTS)).astype(np.uint64)) & np.uint64(0xFFFF)


def chain_links(x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which pairs link: x and y agree in segment `first`; the chain's budgets, then the whole distance."""
    at = np.arange(len(x))
    spent = np.zeros(len(x), np.int64)
    for l in (2, 3):
        k = first[at] + l - 1
        spent = spent + np.bitwise_count(_segment(x[at], k) ^ _segment(y[at], k))
        ok = spent <= l * MAX_BITS // SEGMENTS
        at, spent = at[ok], spent[ok]
    return at[np.bitwise_count(x[at] ^ y[at]) <= MAX_BITS]


def _links_in_run(x: np.ndarray, ring: int) -> Iterator[tuple[int, int]]:
    """Links that connect what is connected within many fingerprints of one bucket, without trying all pairs: first
    neighbours at one bit (equal after masking it), then the chains of what is outside the largest piece with all."""
    forest = Forest()
    for bit in range(64):
        masked = x & ~(np.uint64(1) << np.uint64(bit))
        order = np.argsort(masked, kind="stable")
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        for a, b in zip(x[order[same]].tolist(), x[order[same + 1]].tolist()):
            if forest.add(a, b):
                yield a, b
    roots = np.array([forest.find(v) for v in x.tolist()], np.uint64)
    names, sizes = np.unique(roots, return_counts=True)
    first = np.full(len(x), ring)
    for v in x[roots != names[sizes.argmax()]].tolist():
        for u in x[chain_links(x, np.full(len(x), v, np.uint64), first)].tolist():
            if u != v and forest.add(u, v):
                yield u, v


def bucket_links(keys: np.ndarray, x: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links among rows sorted by key. A key's low two bits are the ring position of its equal segment."""
    links = []
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    length = np.diff(bounds)
    for s, n in zip(bounds[:-1][length > LARGE_BUCKET], length[length > LARGE_BUCKET]):
        links += [p for p in _links_in_run(x[s : s + n], int(keys[s] & 3)) if forest.add(*p)]
    run = np.repeat(length, length)
    at, shift = np.flatnonzero((run > 1) & (run <= LARGE_BUCKET)), 0
    while len(at):
        shift += 1
        at = at[at + shift < len(keys)]
        at = at[keys[at] == keys[at + shift]]
        good = at[chain_links(x[at], x[at + shift], keys[at] & 3)]
        links += [p for p in zip(x[good].tolist(), x[good + shift].tolist()) if forest.add(*p)]
    return links


def links(fps: DataFrame) -> DataFrame:
    """Edges set, a, b between distinct fingerprints fps(set int, fp long) of a set that join all within MAX_BITS of each
    other, directly or by way of others."""
    seg = "shiftrightunsigned(fp, 16 * {k}) & 65535L"
    rows = fps.select(F.col("set").cast("long").alias("set"), "fp", F.expr(f"inline(array({', '.join(f'struct({k}L AS ring, {seg.format(k=k)} AS seg, {seg.format(k=(k + 1) % 4)} AS next)' for k in range(4))}))"))
    # at most 4 * 65,536 buckets a set
    large = rows.groupBy("set", "ring", "seg").count().where(F.col("count") > LARGE_BUCKET).select("set", "ring", "seg", F.lit(True).alias("large"))
    keyed = rows.join(F.broadcast(large), ["set", "ring", "seg"], "left").select(
        "fp",
        "set",
        F.expr(
            "explode(CASE WHEN large THEN transform(sequence(0, 15), j -> shiftleft(next & ~shiftleft(1L, j), 23) | shiftleft(seg, 7) | shiftleft(j + 1L, 2) | ring)"
            " ELSE array(shiftleft(seg, 7) | ring) END)"
        ).alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: dict[int, Forest] = {}
        keys, x = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            x = np.concatenate([x, batch.column("fp").to_numpy().view(np.uint64)])
            done = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on
            yield from _edges(keys[:done], x[:done], forests)
            keys, x = keys[done:], x[done:]
        yield from _edges(keys, x, forests)

    numbered = keyed.select(F.expr(f"key + shiftleft(set, {SET_BIT})").alias("key"), "fp")
    return map_batches(numbered.repartition("key").sortWithinPartitions("key", "fp"), run, "set int, a long, b long")


#: Fingerprints that a task's forest remembers.
MOST_LINKED = 200_000
#: A key has below this bit: ring position, masked bit, equal segment, next segment.
SET_BIT = 40


def _edges(keys: np.ndarray, x: np.ndarray, forests: dict[int, Forest]) -> Iterator[pa.RecordBatch]:
    for k in np.unique(keys >> SET_BIT).tolist():
        part = slice(*np.searchsorted(keys, [k << SET_BIT, (k + 1) << SET_BIT]))
        forest = forests.setdefault(k, Forest())
        if len(forest.up) > MOST_LINKED:
            forest.up.clear()  # some links come twice then
        found = bucket_links(keys[part], x[part], forest)
        table = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        cols = [np.full(len(table), k, np.int32), table[:, 0].copy(), table[:, 1].copy()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["set", "a", "b"])


def near_classes(docs_fp: DataFrame) -> DataFrame:
    """fp, component_id for each distinct fingerprint of docs_fp(doc_id, fp)."""
    distinct = stash(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("doc")), "fingerprints")
    roots = stash(components(links(distinct.select(F.lit(0).alias("set"), "fp"))), "roots")
    member = stash(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")), "members")
    least = stash(member.groupBy("root").agg(F.min("doc").alias("component_id")).withColumnRenamed("root", "r"), "classes")
    return member.join(least, F.col("root") == F.col("r")).select("fp", "component_id")


def simhash_classes(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint, component_id.

    Texts without words (null, empty, white space) have fingerprint zero and link like any other. Rows with a null
    id take part; their class is named by its smallest id, null if it has none. Repeated rows each get their row; texts of any
    length are read whole; an empty table gives no rows. Other columns are ignored.
    """
    docs_fp = stash(fingerprints(docs, shingle), "fps")
    classes = stash(near_classes(docs_fp), "fpclass").withColumnRenamed("fp", "f")
    return docs_fp.join(classes, F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near-dedup of a corpus: 5-word shingles, similarity 0.8

NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
_P, _Q = Fraction(str(NEAR_SIMILARITY)).as_integer_ratio()
#: Texts that are sampled for the shingles that many texts have, and how many of those put a shingle last in the order.
SAMPLE_TEXTS, COMMON_TEXTS, MOST_COMMON = 10_000, 4, 100_000
#: What is compared in a bucket, round by round, of what isn't joined by then: neighbours by length so far apart, all with
#: the texts that have most links so far, every pair.
ROUNDS = (("neighbours", 8), ("hubs", 4), ("all", None))
#: Bits of a text's signature for each of its shingles.
SIGNATURE_BITS = 4


def _shingle_set(data: bytes) -> np.ndarray:
    """The sorted distinct hashes of the 5-word shingles; of all words if there are fewer."""
    digest = xxhash.xxh64_digest
    found: list[np.ndarray] = []
    tail: list[bytes] = []
    for words in word_pieces(data.translate(_LOWER)):
        tail += words
        if len(tail) < NEAR_SHINGLE:
            continue
        joined, lengths = b" ".join(tail), np.fromiter(map(len, tail), np.int64, len(tail))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[: len(tail) - NEAR_SHINGLE + 1].tolist(), ends[NEAR_SHINGLE - 1 :].tolist()
        found.append(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), ">i8"))
        tail = tail[len(tail) - NEAR_SHINGLE + 1 :]
    if not found and tail:
        found.append(np.frombuffer(digest(b" ".join(tail), SEED), ">i8"))
    return np.unique(np.concatenate(found).astype(np.int64)) if found else np.empty(0, np.int64)


def _set_fingerprint(hashes: np.ndarray) -> int:
    """The majority fingerprint of a shingle set, as a signed long."""
    bits = 2 * _count_bits(hashes.astype(">i8").tobytes()) > len(hashes) if len(hashes) else np.zeros(64, bool)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _prefix(hashes: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all texts, rare ones first, of which texts of similarity 0.8 share one at least."""
    n = len(hashes)
    at = np.searchsorted(common, hashes)
    rank = np.zeros(n, np.int64)
    known = at < len(common)
    known[known] = common[at[known]] == hashes[known]
    rank[known] = often[at[known]]
    return hashes[np.lexsort((hashes, rank))[: n - -(-_P * n // _Q) + 1]] if n else hashes


def signature(hashes: np.ndarray) -> bytes:
    """A bit map of SIGNATURE_BITS bits a shingle, rounded up to a power of two, with the bits set that the hashes name."""
    bits = max(8, 1 << max(0, SIGNATURE_BITS * len(hashes) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[hashes & (bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """Whether the signatures leave the similarity possible. A bit that only one text has stands for one shingle or more
    that only it has, so this is false for no pair that is similar."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    shared = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return (_P + _Q) * shared >= _P * (n_a + n_b)


def _common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of a sample, sorted, and how many have them. Only the order of shingles depends on them, no result does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for x in batch.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(x.as_py()))], ["h"])

    parts = -(-rows.count() // SAMPLE_TEXTS)
    counts = map_batches(rows.where(F.pmod(F.xxhash64("data"), F.lit(max(parts, 1))) == 0).select("data"), run, "h long").groupBy("h").count()
    top = counts.where(F.col("count") >= COMMON_TEXTS).orderBy(F.desc("count"), "h").limit(MOST_COMMON).orderBy("h").collect()
    return np.array([r["h"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)


def _distinct_texts(data: DataFrame) -> DataFrame:
    """rid, same: each row's number and that of the first row with its sequence of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            names = []
            for x in batch.column("data"):
                whole = xxhash.xxh3_128(seed=SEED)
                for words in word_pieces(x.as_py().translate(_LOWER)):
                    whole.update(b" ".join(words) + b" ")
                names.append(whole.digest())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("none"), batch.column("doc_id"), pa.array(names, pa.binary())], ["rid", "none", "doc_id", "name"])

    named = map_batches(data.select("rid", F.col("doc_id").isNull().alias("none"), "doc_id", "data"), run, "rid long, none boolean, doc_id long, name binary")
    named = stash(named.repartition("rid"), "named")  # a few files of narrow rows
    first = named.groupBy("name").agg(F.min(F.struct("none", "doc_id", "rid")).alias("first"))
    return stash(named.join(first.withColumnRenamed("name", "n"), F.col("name") == F.col("n")).select("rid", "none", "doc_id", F.col("first.rid").alias("same")), "same")


def _features(data: DataFrame) -> DataFrame:
    """tid, n, fp, signature, prefix of each text of data(rid, data)."""
    common, often = _common_shingles(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [_shingle_set(x.as_py()) for x in batch.column("data")]
            cols = [
                pa.array(map(len, sets), pa.int32()), pa.array(map(_set_fingerprint, sets), pa.int64()), pa.array(map(signature, sets), pa.binary()),
                pa.array([_prefix(h, common, often) for h in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *cols], ["tid", "n", "fp", "signature", "prefix"])

    return stash(map_batches(data, run, "tid long, n int, fp long, signature binary, prefix array<long>"), "features")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by their first column, cut where it changes."""
    held: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        held = [np.concatenate(c) for c in zip(held, cols)] if held else cols
        done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last key may go on
        if done:
            yield [c[:done] for c in held]
            held = [c[done:] for c in held]
    if held:
        yield held


def _buckets(texts: DataFrame) -> DataFrame:
    """key, tid, n, pos: the prefix shingles that more than one text has, with the text's count of shingles and the place in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, which the next may equal, and the key before it
        before: int | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if held:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            if not len(cols[0]):
                continue
            same = cols[0][1:] == cols[0][:-1]
            keep = np.concatenate(([before == cols[0][0]], same))
            keep[:-1] |= same
            before = int(cols[0][-2]) if len(cols[0]) > 1 else before
            held = [c[-1:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in cols], names)
        if held and before == held[0][0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    names = ["key", "tid", "n", "pos"]
    rows = texts.select("tid", "n", F.posexplode("prefix").alias("pos", "key")).select(*names)
    return stash(map_batches(rows.repartition("key").sortWithinPartitions("key"), run, "key long, tid long, n int, pos int"), "buckets")


def bucket_pairs(key: np.ndarray, tid: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, reach: int | None) -> Iterator[np.ndarray]:
    """Pairs a < b that may have the similarity, of rows sorted by key and n, no further apart than reach and of different roots."""
    n, pos, at, shift = n.astype(np.int64), pos.astype(np.int64), np.arange(len(key)), 0
    while len(at) and (reach is None or shift < reach):
        shift += 1
        at = at[at + shift < len(key)]
        to = at + shift
        # rows behind are longer still: what is too short for this one is too short for them
        near = (key[at] == key[to]) & (_Q * n[at] >= _P * n[to])
        at, to = at[near], to[near]
        # of the first shingle that two texts share on, they share no more than what either has left
        good = (root[at] != root[to]) & ((_P + _Q) * np.minimum(n[at] - pos[at], n[to] - pos[to]) >= _P * (n[at] + n[to]))
        if good.any():
            a, b = tid[at[good]], tid[to[good]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """a, b: texts whose fingerprints link by pigeonring, and texts of one fingerprint with its first."""
    first = stash(texts.groupBy("fp").agg(F.min("tid").alias("tid")), "fingerprints")
    linked = links(first.select(F.lit(0).alias("set"), "fp")).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    side = lambda e: first.select(F.col("fp").alias(f"f{e}_"), F.col("tid").alias(e))
    across = linked.join(side("a"), F.col("fa") == F.col("fa_")).join(side("b"), F.col("fb") == F.col("fb_")).select("a", "b")
    within = texts.select("tid", "fp").join(side("a"), F.col("fp") == F.col("fa_")).where("a <> tid").select("a", F.col("tid").alias("b"))
    return across.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def hub_pairs(key: np.ndarray, tid: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, hubs: int) -> Iterator[np.ndarray]:
    """Pairs a < b that may have the similarity, of rows sorted by key, of a key's first `hubs` rows with all others of other roots."""
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    start = np.repeat(first, np.diff(np.append(first, len(key))))
    to = np.arange(len(key))
    for k in range(hubs):
        later = to > start + k
        a, b = start[later] + k, to[later]
        low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        good = (root[a] != root[b]) & (_Q * low >= _P * high) & ((_P + _Q) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= _P * (n[a] + n[b]))
        if good.any():
            a, b = tid[a[good]], tid[b[good]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)


def _candidates(buckets: DataFrame, edges: DataFrame, kind: str, reach: int | None) -> DataFrame:
    """a, b: the distinct pairs of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches):
            for pairs in (hub_pairs if kind == "hubs" else bucket_pairs)(*cols, reach):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], ["a", "b"])

    degrees = edges.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("links"))
    known = stash(components(edges).join(degrees, F.col("node") == F.col("d"), "left").select("node", "root", "links"), "roots")
    rooted = buckets.join(known, F.col("tid") == F.col("node"), "left").select("key", "tid", "n", "pos", F.coalesce("root", "tid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    # a bucket of one root has no pair left
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = rooted.join(open_keys, "key", "left_semi").repartition("key")
    order = (F.col("links").desc(),) if kind == "hubs" else ("n",)
    rows = rows.sortWithinPartitions("key", *order, "tid").select("key", "tid", "n", "pos", "root")
    return map_batches(rows, run, "a long, b long").distinct()


def _possible(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose signatures leave the similarity possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            cols = [batch.column(c).to_pylist() for c in ("a_sig", "a_n", "b_sig", "b_n")]
            yield batch.select(["a", "b"]).filter(pa.array(map(may_be_similar, *cols), pa.bool_()))

    for e in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("tid").alias(f"{e}_tid"), F.col("signature").alias(f"{e}_sig"), F.col("n").alias(f"{e}_n")), F.col(e) == F.col(f"{e}_tid"))
    return stash(map_batches(pairs.select("a", "b", "a_sig", "a_n", "b_sig", "b_n"), run, "a long, b long"), "possible")


def _similar(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """The pairs a, b whose whole shingle sets have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [_shingle_set(x.as_py()) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sets, pa.list_(pa.int64()))], ["tid", "shingles"])

    wanted = rows_in(data, "rid", pairs.select(F.explode(F.array("a", "b")).alias("rid")))
    sets = stash(map_batches(wanted.select("rid", "data"), run, "tid long, shingles array<long>").repartition("tid"), "shingles")
    sides = [sets.select(F.col("tid").alias(f"{e}_tid"), F.col("shingles").alias(f"{e}_set")) for e in ("a", "b")]
    both = pairs.join(sides[0], F.col("a") == F.col("a_tid")).join(sides[1], F.col("b") == F.col("b_tid"))
    return both.where(F.expr(f"{_P + _Q} * size(array_intersect(a_set, b_set)) >= {_P} * (size(a_set) + size(b_set))")).select("a", "b")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text) of which one stays for each group of near copies; all columns stay.

    Texts are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; texts with the same
    lower-case words are one. Groups are connected by links. The row with the smallest doc_id stays (nulls last),
    of repeated rows the first. Texts without words (null, empty) are equal to each other. Texts of any length are read whole. An empty
    table gives none.

    SimHash joins most near copies: texts whose fingerprints link are tested. No 64-bit fingerprint finds every pair of
    similarity 0.8, so the rest is found exactly: in one order of all shingles, similar texts share one of the first
    fifth, so each pair meets in a bucket; only texts already joined by tested links are spared each other. The first
    rounds test neighbours and the texts of most links, so that a cloud of near copies is joined before all its pairs are made. Pairs are
    tested by signatures, which reject none that is similar, then on the whole sets.
    """
    rid = free_name(docs, "near_rid")
    rows = with_row_id(docs, rid)
    data = rows.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    same = _distinct_texts(data)
    data = rows_in(data, "rid", same.where("rid = same").select("rid"))
    texts = _features(data.select("rid", "data"))

    edges = stash(_similar(_possible(_fingerprint_pairs(texts), texts), data), "similar")
    buckets = _buckets(texts)
    for kind, reach in ROUNDS:
        pairs = stash(_candidates(buckets, edges, kind, reach), "pairs")
        edges = stash(edges.unionByName(_similar(_possible(pairs, texts), data)), "similar")

    member = same.join(components(edges), F.col("same") == F.col("node"), "left").select("rid", "none", "doc_id", F.coalesce("root", "same").alias("group"))
    member = stash(member, "members")
    kept = member.groupBy("group").agg(F.min(F.struct("none", "doc_id", "rid")).alias("kept")).select("kept.rid")
    return rows_in(rows, rid, kept).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(load(spark, sf_dir, "documents"))
