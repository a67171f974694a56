"""Streams as ordered pieces of bytes, read forward by parsers that hold no more than the message they are at.

The pieces of a stream are consecutive rows of one partition: the client's side in order, then the server's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHO = ("file", "index", "client", "client_port", "server", "server_port", "start_ts")


class Feed:
    """Bytes that come in pieces, taken from the front."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.pos = pieces, b"", 0

    def pull(self) -> bool:
        """Get more bytes, as many as are held, so that a long search copies each byte a few times only."""
        parts = [self.held[self.pos :]]
        got, want = 0, max(1, len(parts[0]))
        for piece in self.pieces:
            parts.append(piece)
            got += len(piece)
            if got >= want:
                break
        self.held, self.pos = b"".join(parts), 0
        return got > 0

    def ahead(self) -> int:
        return len(self.held) - self.pos

    def find(self, what: bytes, most: int | None = None, start: int = 0) -> int:
        """How far ahead `what` is, from start on; -1 if it isn't there, or not within `most` bytes."""
        at = start
        while True:
            found = self.held.find(what, self.pos + at)
            if found >= 0:
                return found - self.pos
            at = max(start, self.ahead() - len(what) + 1)
            if most is not None and self.ahead() > most or not self.pull():
                return -1

    def peek(self, n: int) -> bytes:
        while self.ahead() < n and self.pull():
            pass
        return self.held[self.pos : self.pos + n]

    def take(self, n: float, keep: int | None = None) -> tuple[bytes, int]:
        """Move n bytes on, or to the end: the first `keep` of them, and how many there were."""
        parts, kept, had = [], 0, 0
        while had < n and (self.ahead() or self.pull()):
            k = int(min(n - had, self.ahead()))
            part = self.held[self.pos : self.pos + (k if keep is None else min(k, keep - kept))]
            parts.append(part)
            kept, had = kept + len(part), had + k
            self.pos += k
        return b"".join(parts), had

    def past(self, what: bytes) -> bool:
        """Move behind the next `what`, or to the end, without holding what is in between."""
        while True:
            found = self.held.find(what, self.pos)
            if found >= 0:
                self.pos = found + len(what)
                return True
            self.pos = max(self.pos, len(self.held) - len(what) + 1)
            if not self.pull():
                self.pos = len(self.held)
                return False

    def lines(self, most: int | None = None, longest: int | None = None) -> Iterator[bytes]:
        """What lies between CR LFs, the last without one too, in turn; of each the first `longest` bytes."""
        n = 0
        while most is None or n < most:
            end = self.find(b"\r\n", longest)
            if end >= 0:
                yield self.take(end + 2)[0][:-2][:longest]
            elif longest is not None and self.ahead() > longest:
                line = self.peek(longest)
                more = self.past(b"\r\n")
                yield line
                if not more:
                    return
            else:
                yield self.take(float("inf"))[0]
                return
            n += 1


def as_chunks(streams: DataFrame) -> DataFrame:
    """streams with their bytes in pieces: they are already, or c2s and s2c hold a side each."""
    if "chunk" in streams.columns:
        return streams
    side = lambda c: F.struct(F.lit(c).alias("side"), F.col(c).alias("chunk"))
    return streams.select(*WHO, F.explode(F.array(side("c2s"), side("s2c"))).alias("s")).select(*WHO, "s.*")


def by_stream(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = WHO) -> Iterator[tuple[dict, Iterator[tuple[str, Feed]]]]:
    """(columns of the stream, its sides with their bytes) of each stream in turn; sides without bytes don't come."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            who = zip(*(batch.column(c).to_pylist() for c in columns))
            yield from zip(who, batch.column("side").to_pylist(), batch.column("chunk"))

    where = [columns.index(c) for c in ("file", "index")]
    for _, group in groupby(rows(), key=lambda r: tuple(r[0][k] for k in where)):
        first = next(group)
        whole = ((side, chunk) for _, side, x in chain((first,), group) if (chunk := x.as_py()))
        yield dict(zip(columns, first[0])), ((side, Feed(chunk for _, chunk in own)) for side, own in groupby(whole, key=itemgetter(0)))


def parsed(streams: DataFrame, rows_of: Callable[[dict, Iterator[tuple[str, Feed]]], Iterator[dict]], schema: str, types: pa.Schema, most_rows: int = 64) -> DataFrame:
    """A row for each that rows_of gives of a stream and its sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for who, sides in by_stream(batches):
            for row in rows_of(who, sides):
                held.append(row)
                if len(held) >= most_rows:
                    yield pa.RecordBatch.from_pylist(held, types)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, types)

    return as_chunks(streams).select(*WHO, "side", "chunk").mapInArrow(run, schema)
