"""Token-ID output: fixed-width bit packing in blocks.

Documents in ascending doc_id order are encoded, and their ids stored with the fewest bits the vocabulary needs.
A block is a row of the output table: the packed ids of whole consecutive documents, where each of them ends, and
where the block starts in its part of the order. The table is written with Spark's Parquet writer, so it can be in
any store and a failed task leaves nothing; a reader picks blocks by part and position and unpacks them, or a
slice of one, with numpy.

Scale: one range shuffle of the texts, with ties of doc_id split by row. Offsets of parts are a sum over the
small columns. The tokenizer sees each distinct word of a task once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, map_batches, shared_folder, sliced, text_or_empty, with_row_id, worker_copy

END_ID = 2
BLOCK_IDS = 1 << 16
#: Characters of a text that are split into words at a time; words that a task remembers.
PIECE, MOST_WORDS = 1 << 20, 400_000
#: Distinct words of letters encoded together.
JOINED = 4096
BLOCKS = "part int, block int, first_id long, n_ids long, width int, doc_ids array<long>, ends array<long>, payload binary"


def width_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in width bits, lowest bit first, without padding but for the last byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for k in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a byte
        part = ids[k : k + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, n_ids: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """count ids from start on, reading only their bytes."""
    start = min(start, n_ids)
    count = n_ids - start if count is None else min(count, n_ids - start)
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    lead = start % 8
    data = np.frombuffer(payload, np.uint8)[start // 8 * width : -(-(start + count) * width // 8)]
    bits = np.unpackbits(data, bitorder="little")[: (lead + count) * width].reshape(-1, width)
    wide = np.zeros((len(bits), 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()[lead:].astype(np.uint32)


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    No token of this tokenizer's kind spans white space, so a text's ids are those of its words in turn. Words of
    letters alone are encoded many at a time, joined by spaces: each is one piece and so ends at a token with the
    end-of-word suffix.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        #: number of each known word, and of each part of one
        self.at: dict[str, int] = {}
        # where a number's ids start in flat, and how many they are
        self.start, self.length, self.hits, self.flat = (np.zeros(1 << 16, t) for t in (np.int64, np.int32, np.int32, np.uint32))
        self.known = self.used = 0

    def _trim(self) -> None:
        """Forget the words seen once, and of more than half the room the rarest; the others' counts are halved."""
        hits = self.hits[: self.known]
        least = max(2, int(np.partition(hits, -MOST_WORDS // 2)[-MOST_WORDS // 2]) + 1)
        keep = hits >= least
        number = np.cumsum(keep) - 1
        at = {w: int(number[k]) for w, k in self.at.items() if keep[k]}
        kept = np.flatnonzero(keep)
        lengths, ids, hits = self.length[kept], self._gather(kept), hits[kept] >> 1
        self._clear()
        self.at = at
        self._store(lengths, ids)
        self.hits[: self.known] = hits

    def _store(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.start = _room(self.start, self.known + len(lengths))
        self.length = _room(self.length, self.known + len(lengths))
        self.hits = _room(self.hits, self.known + len(lengths))
        self.flat = _room(self.flat, self.used + len(ids))
        at = slice(self.known, self.known + len(lengths))
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.length[at] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.known, self.used = at.stop, self.used + len(ids)

    def _encode_parts(self, parts: list[str], joined: bool) -> None:
        """Number and store parts that aren't known; joined: they are letters alone."""
        for k in range(0, len(parts), JOINED):
            group = parts[k : k + JOINED]
            if joined:
                ids = np.array(self.tok.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.uint32)
                last = np.flatnonzero(self.ends[ids])
            if not joined or len(last) != len(group):
                lists = [e.ids for e in self.tok.encode_batch_fast(group, add_special_tokens=False)]
                ids = np.fromiter((i for x in lists for i in x), np.uint32)
                last = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))) - 1
            self.at.update(zip(group, range(self.known, self.known + len(group))))
            self._store(np.diff(last, prepend=-1), ids)

    def _learn(self, words: list[str]) -> None:
        """Words apart from case and closing punctuation share the encoding of their letters.

        The case is lowered first: a letter such as U+0130 becomes a letter and a mark, which the tokenizer keeps with
        the punctuation behind it.
        """
        at, letters, others, changed = self.at, {}, {}, []
        for w in words:
            bare = w.rstrip(punctuation)
            low = bare.lower() if bare.isascii() or max(bare) < "\u0180" else ""
            if low.isalpha():
                if low not in at:
                    letters[low] = None
                if low != w:
                    changed.append((w, low, w[len(bare) :]))
                    if len(bare) < len(w) and w[len(bare) :] not in at:
                        others[w[len(bare) :]] = None
            elif w not in at:
                others[w] = None
        self._encode_parts(list(letters), joined=True)
        self._encode_parts(list(others), joined=False)
        at.update((w, at[low]) for w, low, closing in changed if not closing)
        if two := [(w, at[low], at[closing]) for w, low, closing in changed if closing]:
            k = np.array([t[1:] for t in two], np.int64)
            at.update(zip((t[0] for t in two), range(self.known, self.known + len(two))))
            self._store(self.length[k].sum(axis=1), self._gather(k.ravel()))

    def _gather(self, k: np.ndarray) -> np.ndarray:
        n = self.length[k]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[k] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        k = self._numbers(words)
        if len(missing := np.flatnonzero(k < 0)):
            unknown = [words[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            k[missing] = self._numbers(unknown)
        self.hits[: self.known] += np.bincount(k, minlength=self.known).astype(np.int32)
        out = self._gather(k), self.length[k]
        if len(self.at) > MOST_WORDS:
            self._trim()
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def word_lists(text: str) -> Iterator[list[str]]:
    """Words between white space, in lower case where that is safe, of about PIECE characters at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and text[end] not in " \t\n\r\x0b\x0c":
            end += 1
        piece = text[start:end]
        if "<|" not in piece and not _BEYOND_LATIN.search(piece):  # special tokens have their case
            piece = piece.lower()  # as the tokenizer does, letter by letter
        # these four are no white space to the tokenizer
        yield piece.split() if not _SEPARATORS.search(piece) else [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", piece) if w]
        start = end


_SEPARATORS = re.compile("[\x1c-\x1f]")
_BEYOND_LATIN = re.compile("[\u0180-\U0010ffff]")


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs(doc_id, text) in ascending doc_id order (nulls first) and write the blocks to path.

    Null text counts as empty: the end id alone. Repeated rows are all written. A document longer than block_ids
    has a block of its own.
    """
    width = width_for(max(vocabulary, end_id + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_copy(WordEncoder, tokenizer_path), TaskContext.get().partitionId()
        block = first = held = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            row = {"part": part, "block": block, "first_id": first, "n_ids": held, "width": width, "doc_ids": names, "ends": ends, "payload": pack(np.concatenate(ids), width)}
            return pa.RecordBatch.from_pylist([row], _BLOCK_TYPES)

        def encoded(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, bool]]:
            """(doc_id, ids, whether the document ends) in order, some ten thousand words encoded at a time."""
            words: list[str] = []
            cuts: list[tuple[int | None, int, bool]] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for more in word_lists(text):
                    words += more
                    cuts.append((doc_id, len(words), False))
                    if len(words) >= PIECE // 16:
                        yield from cut(words, cuts)
                        words, cuts = [], []
                cuts.append((doc_id, len(words), True))
            yield from cut(words, cuts)

        def cut(words: list[str], cuts: list[tuple[int | None, int, bool]]) -> Iterator[tuple[int | None, np.ndarray, bool]]:
            got, n = encoder.encode(words)
            upto, a = np.concatenate(([0], np.cumsum(n))), 0
            for doc_id, k, ended in cuts:
                yield doc_id, got[a : upto[k]], ended
                a = upto[k]

        end = np.array([end_id], np.uint32)
        for batch in sliced(batches):
            for doc_id, got, ended in encoded(batch):
                ids.append(got)
                held += len(got)
                if ended:
                    ids.append(end)
                    held += 1
                    names.append(doc_id)
                    ends.append(held)
                    if held >= block_ids:
                        yield flush()
                        block, first, held, ids, names, ends = block + 1, first + held, 0, [], [], []
        if names:
            yield flush()

    rows = with_row_id(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")))
    ordered = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    map_batches(ordered.select("doc_id", "text"), run, BLOCKS).write.parquet(path)


_BLOCK_TYPES = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())]
)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at path with `offset`: the ids of all documents before the block."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row of 12 bytes for each part, and there are as many parts as tasks
    return blocks.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("offset", F.col("base") + F.col("first_id")).drop("p", "base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from its unpacked ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 16):
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], row["n_ids"]).astype("<u4")
                ends = np.array(row["ends"], np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts, ends)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["offset"]), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = read_blocks(spark, path).select("n_ids", "width", "offset", "doc_ids", "ends", "payload")
    return map_batches(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> tuple[str, int]:
    """Path and vocabulary size of the public word BPE."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), 49_408


def token_table(docs: DataFrame, tokenizer_path: str | None = None, vocabulary: int | None = None) -> DataFrame:
    """Write docs as blocks to the shared folder and read the documents back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer_path is None:
        tokenizer_path, vocabulary = default_tokenizer()
    path = shared_folder(docs.sparkSession, "tokens")
    write_blocks(docs, path, tokenizer_path, vocabulary)
    return read_documents(docs.sparkSession, path)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(load(spark, sf_dir, "documents"))
