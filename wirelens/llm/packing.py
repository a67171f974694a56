"""Best-fit packing of token pieces into sequences by bin completion.

Tokenized documents are cut into pieces where they lie. Which lengths share a sequence depends only on how many pieces
there are of each length, a histogram of at most `capacity` numbers. Bin completion works on it: around the largest
length left, the fillings that no other one dominates are enumerated, and the first is applied as often
as its lengths last. When few sequences are left, branch and bound goes through the fillings of each of them and prunes by
the waste that a solution of so many sequences may have. Best-fit solutions are the incumbents, of the whole and of the
rest; several descents differ in how much a sequence may waste before shorter pieces are spent on it.

A piece then finds its place by its rank among the pieces of its length: the rank in its part is counted while it is
cut, and a running sum over parts adds what comes before. No length's pieces ever meet in one task.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, map_batches, sliced, stash, text_or_empty, worker_copy

CAPACITY, END_ID = 1024, 2
#: Sequences that branch and bound completes, the fillings it tries for all of them, and those it compares for one.
TAIL, NODES, WIDTH = 48, 400, 24
#: Longest items of a filling whose subsets are held against the lengths left; and how freely a sequence may waste, in turn.
SUBSETS, EASE = 10, (0, 1, 2, 4, 8)

PIECES = "part int, k long, doc_id long, piece int, start long, length long, ids_crc32 long"
Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


# -- which lengths share a sequence -----------------------------------------------------------------------------------


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: for each t, lengths over capacity - t stand alone, and what halves leave free takes those of t or more."""
    upto = np.zeros(capacity + 2, object)
    room = np.zeros(capacity + 2, object)
    for length, c in counts.items():
        upto[length] += c
        room[length] += c * length
    upto, room = np.cumsum(upto), np.cumsum(room)
    best = -(-int(room[capacity]) // capacity)
    for t in range(1, capacity // 2 + 1):
        alone = upto[capacity] - upto[capacity - t]
        large = upto[capacity - t] - upto[capacity // 2]
        free = large * capacity - (room[capacity - t] - room[capacity // 2])
        small = room[capacity // 2] - room[t - 1]
        best = max(best, int(alone + large + max(0, -(-(small - free) // capacity))))
    return best


class Lengths:
    """How many pieces of each length are left, and the fillings that they allow."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {length: c for length, c in counts.items() if c}
        self.capacity = capacity
        self.total = sum(length * c for length, c in self.left.items())

    def take(self, filling: Filling, times: int = 1) -> None:
        for length in set(filling):
            c = self.left.get(length, 0) - times * filling.count(length)
            if c:
                self.left[length] = c
            else:
                del self.left[length]
        self.total -= times * sum(filling)

    def give(self, filling: Filling) -> None:
        for length in filling:
            self.left[length] = self.left.get(length, 0) + 1
        self.total += sum(filling)

    def fillings(self, waste: int, easy: int = 0) -> Iterator[Filling]:
        """Undominated fillings around the largest length left, with at most so much waste: those that waste no more than
        `easy`, which take the longest first and so keep the short ones, and then the fuller ones first."""
        largest = max(self.left)
        room = self.capacity - largest
        own = self.left[largest] - 1
        lengths = sorted((x for x in self.left if x <= room and (x != largest or own)), reverse=True)
        copies = [min(own if x == largest else self.left[x], room // x) for x in lengths]
        mask, present, named = (1 << (room + 1)) - 1, sum(1 << x for x in lengths), dict(zip(lengths, copies))
        reach = [1] * (len(lengths) + 1)  # reach[k]: the sums, as bits, that lengths k, k + 1, ... can make
        for k in range(len(lengths) - 1, -1, -1):
            bits, c, step = reach[k + 1], copies[k], 1
            while c:
                bits |= bits << (lengths[k] * min(step, c))
                c -= min(step, c)
                step *= 2
            reach[k] = bits & mask

        def wasting(least: int, most: int) -> Iterator[Filling]:
            stack = [((), 0, 0, room)]  # chosen, next length, copies of it already chosen, what is still free
            while stack:
                chosen, k, used, rest = stack.pop()
                while k < len(lengths) and lengths[k] > rest:
                    k, used = k + 1, 0
                if k == len(lengths):
                    if least <= rest <= most and not self._dominated(chosen, rest, present, named):
                        yield (largest, *chosen)
                    continue
                low, high = rest - most, rest - least  # what is to be added
                if high < 0 or not reach[k] >> max(low, 0) & ((1 << (high - max(low, 0) + 1)) - 1):
                    continue
                stack.append((chosen, k + 1, 0, rest))
                if used < copies[k]:
                    stack.append((chosen + (lengths[k],), k, used + 1, rest - lengths[k]))

        waste, easy = min(waste, room), min(easy, waste, room)
        yield from wasting(0, easy)
        for over in range(easy + 1, waste + 1):
            if reach[0] >> (room - over) & 1:
                yield from wasting(over, over)

    @staticmethod
    def _dominated(chosen: Filling, waste: int, present: int, copies: dict[int, int]) -> bool:
        """Whether a length that is left fits too, or could replace some of the chosen ones and fill no less."""
        free = present
        for x in set(chosen):
            if chosen.count(x) >= copies[x]:
                free &= ~(1 << x)
        made = {(0, 0)}
        for x in chosen[:SUBSETS]:
            made |= {(n + 1, s + x) for n, s in made}
        # a single one, or none, gives way only to a longer one
        return any(free >> (s + (n < 2)) & ((1 << (waste + (n >= 2))) - 1) for n, s in made)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit decreasing: pieces of each length go where they leave least room, all alike at once."""
    open_: dict[int, list[tuple[Filling, int]]] = {}  # free room -> fillings and how many sequences have them
    rooms = 0  # the keys of open_, as bits

    def put(filling: Filling, times: int) -> None:
        nonlocal rooms
        room = capacity - sum(filling)
        open_.setdefault(room, []).append((filling, times))
        rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            fit = rooms >> length
            if not fit:
                each = min(c, capacity // length)
                put((length,) * each, c // each)
                c %= each
                continue
            room = length + (fit & -fit).bit_length() - 1
            filling, times = open_[room].pop()
            if times > c:
                open_[room].append((filling, times - c))
            if not open_[room]:
                del open_[room]
                rooms &= ~(1 << room)
            put((*filling, length), min(times, c))
            c -= min(times, c)
    return [f for found in open_.values() for f in found]


def branch_and_bound(counts: dict[int, int], capacity: int, ease: int = 0, nodes: int = NODES) -> Plan:
    """The fewest sequences found for few pieces: for ever more sequences a search for a solution that wastes no more than
    they allow, the fullest fillings first, then with `ease`. After so many nodes each the best-fit solution stays."""
    incumbent = best_fit(counts, capacity)
    left = Lengths(counts, capacity)
    spent = 0

    def search(bins: int, waste: int, path: list[Filling], ease: int) -> list[Filling] | None:
        nonlocal spent
        if not left.left:
            return list(path)
        for tried, filling in enumerate(left.fillings(waste, ease * waste // max(bins, 1))):
            if spent >= nodes or tried == WIDTH:
                return None
            spent += 1
            left.take(filling)
            path.append(filling)
            found = search(bins - 1, waste - (capacity - sum(filling)), path, ease)
            path.pop()
            left.give(filling)
            if found is not None:
                return found
        return None

    for k in range(least_sequences(counts, capacity), sum(times for _, times in incumbent)):
        for e in {0, ease}:
            spent = 0
            if (found := search(k, k * capacity - left.total, [], e)) is not None:
                return [(f, 1) for f in found]
    return incumbent


def descent(counts: dict[int, int], capacity: int, ease: int, tail: int) -> Plan:
    """Complete the largest length left until `tail` sequences are left, and search for the best of those. A sequence may waste
    `ease` times its share of what the lower bound leaves."""
    left = Lengths(counts, capacity)
    bins = least_sequences(counts, capacity)
    out: Plan = []
    while left.left and left.total > tail * capacity:
        share = (bins * capacity - left.total) // bins if bins * capacity > left.total else 0
        filling = next(left.fillings(capacity, ease * share))
        times = min(left.left[x] // filling.count(x) for x in set(filling))
        left.take(filling, times)
        out.append((filling, times))
        bins -= times
    return out + branch_and_bound(dict(left.left), capacity, ease) if left.left else out


def completed(counts: dict[int, int], capacity: int = CAPACITY, tail: int = TAIL) -> Plan:
    """(lengths that share a sequence, how many such sequences), over all the pieces of counts(length -> pieces)."""
    counts = {length: c for length, c in counts.items() if c}
    best, least = best_fit(counts, capacity), least_sequences(counts, capacity)
    for ease in EASE:
        if sum(times for _, times in best) == least:
            break
        best = min(best, descent(counts, capacity, ease, tail), key=lambda plan: sum(times for _, times in plan))
    return best


# -- pieces -----------------------------------------------------------------------------------------------------------


class ByteEncoder:
    """Ids of the byte-level BPE, read from its ranks; its special token's text is that token, as the JSON file has it."""

    def __init__(self, ranks_path: str, pattern: str, special: tuple[str, int]) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tok = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special[0]: special[1]})
        self.special = {special[0]}

    def encode(self, text: str) -> np.ndarray:
        return self.tok.encode_to_numpy(text, allowed_special=self.special)


def default_encoder() -> tuple[str, str, tuple[str, int]]:
    """Ranks and pattern of the public byte-level BPE, whose vocabulary is that of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>", 50256)


def cut_pieces(docs: DataFrame, encoder: tuple, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text), with k, the rank of a piece among those of its length in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = worker_copy(ByteEncoder, *encoder), TaskContext.get().partitionId()
        seen, end = [0] * (capacity + 1), np.array([end_id], np.uint32)
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate((codec.encode(text.as_py()), end)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((part, seen[b - a], doc_id, piece, a, b - a, zlib.crc32(ids[a:b].data), *((ids[a:b],) if keep_ids else ())))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["part", "k", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * keep_ids]
    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, PIECES + ", ids array<long>" * keep_ids)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(part, k, length, ...), written before, with sequence_id and offset."""
    spark = pieces.sparkSession
    sizes = stash(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c")), "sizes")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("c").alias("n")).collect()}  # at most `capacity` rows
    plan, first, taken = [], 0, dict.fromkeys(counts, 0)
    for filling, times in completed(counts, capacity):
        at = 0
        for length in sorted(set(filling), reverse=True):
            many = filling.count(length)
            plan.append((length, taken[length], taken[length] + many * times, first, many, at))
            taken[length] += many * times
            at += many * length
        first += times
    # each filling uses up a length or a kind of room, or is one of the last TAIL: the rows are bounded by the capacity, not by the pieces
    plan_rows = F.broadcast(spark.createDataFrame(plan, "of long, low long, high long, first long, many long, at long"))
    before = Window.partitionBy("of_length").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), "c").withColumn("base", F.coalesce(F.sum("c").over(before), F.lit(0)))
    ranked = pieces.join(bases, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length"))).withColumn("rank", F.col("base") + F.col("k"))
    placed = ranked.join(plan_rows, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    turn = F.col("rank") - F.col("low")
    return placed.select(*pieces.drop("part", "k").columns, (F.col("first") + F.floor(turn / F.col("many"))).alias("sequence_id"), (F.col("at") + F.pmod(turn, F.col("many")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, encoder: tuple | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset; keep_ids adds ids.

    A document is its text's ids and end_id; one of more than `capacity` ids is cut into pieces of that size, the first of
    which may be shorter. Null and empty texts are the end id alone. Texts of any length are encoded whole. Repeated rows, and
    rows of the same or null doc_id, each have their own pieces. An empty table gives no rows. Which of the pieces of equal
    length goes where is not defined. Other columns are ignored.
    """
    return place(stash(cut_pieces(docs, encoder or default_encoder(), capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(docs: DataFrame, encoder: tuple | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, for training. A sequence has at most `capacity` ids."""
    packed = pack(docs, encoder, capacity, end_id, keep_ids=True)
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
