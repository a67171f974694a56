"""Capture files (pcap, pcapng, gzip of either) as packet rows.

A file of up to a range's size is one row of Spark's binaryFile source, so it can be in any store Spark reads, and one task walks
its records. A larger one is cut into byte ranges, of 128 MB or a core's share of all bytes. Where records begin can't be told from a place inside a capture, so a first
pass over each range looks for a run of plausible record headers, walks from there and says where its records begin and end;
ranges whose begin is not the end of the range before are walked again from the right place, until all meet. What is read
is then exactly what one walk through the file reads: the search only decides how much is walked twice. The second pass
reads and dissects the ranges on as many tasks. Workers open large files themselves; where they can't (a store that only
Spark knows, or gzip, which has no places to begin) one task reads the file.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookups import CAPTURE_MAGIC, LINKTYPES
from .dissect import PACKET_SCHEMA, packet_batch

BATCH = 8192
#: Bytes of a range of a large file at most, and at least where there are more cores than such ranges; bytes read at a time.
SPLIT_BYTES, LEAST_SPLIT, READ = 128 << 20, 1 << 20, 4 << 20
#: No record is longer; headers that must follow each other where a range begins, and the longest record looked for there.
MOST_RECORD, RUN, MOST_SOUGHT = 128 << 20, 6, 256 << 10
# Formats of capture files.
PCAPNG, GZIP = b"\x0a\x0d\x0d\x0a", b"\x1f\x8b"
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
BLOCKS = {SECTION, INTERFACE, 2, SIMPLE, 4, 5, ENHANCED, 9, 10}


class CaptureError(Exception):
    """A file that is missing, empty or no capture."""


# -- reading forward ----------------------------------------------------------------------------------------------------


class Unpacked:
    """The bytes of a gzip file, member by member; cut tells whether they ended early."""

    def __init__(self, f) -> None:
        self.f, self.packed, self.member, self.cut, self.ended = f, b"", zlib.decompressobj(31), False, False

    def read(self, n: int) -> bytes:
        while not self.ended:
            if not self.packed and not (packed := self.f.read(READ)):
                self.cut, self.ended = not self.member.eof, True
                break
            self.packed = self.packed or packed
            if self.member.eof:
                self.packed = self.packed.lstrip(b"\0")  # padding between members
                if not self.packed:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.packed, n)
            except zlib.error:
                self.cut, self.ended = True, True
                break
            self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if out:
                return out
        return b""


class Tape:
    """A file read forward from a place; what is behind is let go."""

    def __init__(self, f, at: int = 0) -> None:
        self.f, self.at, self.held, self.pos = f, at, b"", 0
        if not isinstance(f, Unpacked):
            f.seek(at)

    def ahead(self, n: int) -> bool:
        """Whether n bytes follow; they are then in held from pos on."""
        if self.pos + n <= len(self.held):
            return True
        parts = [self.held[self.pos :]]
        have = len(parts[0])
        while have < n and (got := self.f.read(max(READ, n - have))):
            parts.append(got)
            have += len(got)
        self.held, self.pos = b"".join(parts), 0
        return have >= n

    def skip(self, n: int) -> None:
        self.pos += n
        self.at += n


def _tape(f, at: int = 0) -> Tape:
    """A tape over the file, unpacked if it is gzipped."""
    packed = f.read(2) == GZIP
    f.seek(0)
    return Tape(Unpacked(f)) if packed else Tape(f, at)


@dataclass
class Kind:
    """A capture's format as its first bytes have it."""

    name: str
    order: str
    units: int = 1_000_000
    link: int = 1
    first_second: int = 0

    @property
    def detail(self) -> str:
        return "" if self.name == "pcapng" else f"{'little' if self.order == '<' else 'big'}-endian, {'micro' if self.units == 1_000_000 else 'nano'}second"


def _kind(tape: Tape) -> Kind:
    """Told from the start of the file; CaptureError for anything else. The tape stays where it is."""
    if not tape.ahead(4):
        raise CaptureError("no capture: unknown magic" if tape.held else "the file is empty")
    magic = tape.held[:4]
    if magic == PCAPNG:
        return Kind("pcapng", _section_order(tape))
    if magic not in CAPTURE_MAGIC:
        raise CaptureError("no capture: unknown magic")
    _, order, units = CAPTURE_MAGIC[magic]
    link = struct.unpack_from(order + "I", tape.held, 20)[0] & 0xFFFF if tape.ahead(24) else 1
    return Kind("pcap", order, units, link, struct.unpack_from(order + "I", tape.held, 24)[0] if tape.ahead(28) else 0)


def _section_order(tape: Tape) -> str:
    return "<" if tape.ahead(12) and tape.held[tape.pos + 8 : tape.pos + 12] == b"\x4d\x3c\x2b\x1a" else ">"


def detect_format(data: bytes) -> tuple[str, str]:
    """(pcap or pcapng, byte order and time unit); CaptureError for anything else."""
    kind = _kind(_tape(io.BytesIO(data)))
    return kind.name, kind.detail


# -- records --------------------------------------------------------------------------------------------------------------


@dataclass
class Section:
    """What the blocks of a pcapng section have said so far."""

    order: str = "<"
    #: (link type, time units a second, name)
    interfaces: list[tuple[int, int, str]] = field(default_factory=list)
    began: bool = False
    #: names of the interfaces of all sections
    names: list[str] = field(default_factory=list)


Record = tuple[int, int, bytes, int]


def _pcap_records(tape: Tape, kind: Kind, stop: float) -> Iterator[Record]:
    head, each = struct.Struct(kind.order + "IIII"), 1_000_000_000 // kind.units
    while tape.at < stop and tape.ahead(16):
        sec, frac, held, wire = head.unpack_from(tape.held, tape.pos)
        if held > MOST_RECORD or not tape.ahead(16 + held):
            return
        at = tape.pos + 16
        yield sec * 1_000_000_000 + frac * each, kind.link, tape.held[at : at + held], wire
        tape.skip(16 + held)


def _pcapng_records(tape: Tape, section: Section, stop: float) -> Iterator[Record]:
    while tape.at < stop and tape.ahead(12):
        if tape.held[tape.pos : tape.pos + 4] == PCAPNG:
            section.order, section.interfaces, section.began = _section_order(tape), [], True
        block, size = struct.unpack_from(section.order + "II", tape.held, tape.pos)
        if size < 12 or size > MOST_RECORD or not tape.ahead(size):
            return
        data, at = tape.held, tape.pos
        if block == INTERFACE:
            section.interfaces.append(_interface(data[at + 8 : at + size - 4], section.order))
            section.names.append(section.interfaces[-1][2])
        elif block == ENHANCED and size >= 32:
            iface, high, low, held, wire = struct.unpack_from(section.order + "IIIII", data, at + 8)
            link, per_second, _ = section.interfaces[iface] if iface < len(section.interfaces) else (1, 1_000_000, "")
            yield (high << 32 | low) * 1_000_000_000 // per_second, link, data[at + 28 : at + 28 + min(held, size - 32)], wire
        elif block == SIMPLE and section.interfaces:
            (wire,) = struct.unpack_from(section.order + "I", data, at + 8)
            yield 0, section.interfaces[0][0], data[at + 12 : at + 12 + min(wire, size - 16)], wire
        tape.skip(size)


def _interface(body: bytes, order: str) -> tuple[int, int, str]:
    """(link type, timestamp units a second, name) of an interface block."""
    (link,), per_second, name, at = struct.unpack_from(order + "H", body), 1_000_000, "", 8
    while at + 4 <= len(body):
        code, n = struct.unpack_from(order + "HH", body, at)
        value = body[at + 4 : at + 4 + n]
        if code == 0:
            break
        if code == 2:
            name = value.rstrip(b"\0").decode("utf-8", "replace")
        elif code == 9 and value:
            per_second = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        at += 4 + (n + 3) // 4 * 4
    return link, per_second, name


def _walk(tape: Tape, kind: Kind, section: Section, stop: float) -> Iterator[Record]:
    return _pcap_records(tape, kind, stop) if kind.name == "pcap" else _pcapng_records(tape, section, stop)


def records(data: bytes) -> Iterator[Record]:
    """(time in nanoseconds, link type, bytes, length on the wire) of each record; a cut record ends the walk."""
    tape = _tape(io.BytesIO(data))
    kind = _kind(tape)
    tape.skip(24 if kind.name == "pcap" else 0)
    yield from _walk(tape, kind, Section(kind.order), float("inf"))


# -- ranges ---------------------------------------------------------------------------------------------------------------


def _sought(data: bytes, kind: Kind, order: str, whole: bool) -> int | None:
    """The first place in data where a run of plausible record headers begins. whole: data reach to the end of the file."""

    def size_at(at: int) -> int:
        """The size of a plausible record at a place, else 0."""
        if kind.name == "pcap":
            sec, frac, held, wire = struct.unpack_from(order + "IIII", data, at)
            fits = frac < kind.units and held <= MOST_SOUGHT and held <= wire <= 1 << 28 and abs(sec - kind.first_second) < 1 << 29
            return 16 + held if fits else 0
        block, size = struct.unpack_from(order + "II", data, at)
        fits = block in BLOCKS and 12 <= size <= MOST_SOUGHT and size % 4 == 0 and at + size <= len(data) and data[at + size - 4 : at + size] == data[at + 4 : at + 8]
        return size if fits else 0

    head = 16 if kind.name == "pcap" else 12
    for start in range(max(0, len(data) - head + 1)):
        at, seen = start, 0
        while seen < RUN and at + head <= len(data) and (size := size_at(at)):
            at, seen = at + size, seen + 1
        if seen == RUN or seen and whole and at == len(data):
            return start
    return None


@dataclass
class Walked:
    """A range's records: where they begin and end (the end is the next range's begin), how many they are, and of pcapng what
    the section is at the end. simple counts blocks that are records only if an interface came before the range."""

    first: int
    next: int
    n: int = 0
    simple: int = 0
    #: byte order that the range was walked with from its begin, and at its end
    assumed: str = ""
    order: str = ""
    began: bool = False
    interfaces: list[tuple[int, int, str]] = field(default_factory=list)
    first_link: int = -1
    cut: bool = False
    names: list[str] = field(default_factory=list)


def walk_range(f, size: int, start: int, stop: int, first: int | None = None, order: str | None = None) -> Walked:
    """Walk the records that begin from start to stop - 1; first is where they begin, if that is known."""
    tape = _tape(f)
    kind = _kind(tape)
    if isinstance(tape.f, Unpacked):
        if start:
            return Walked(size, size, assumed=kind.order, order=kind.order)
        stop = float("inf")
    order = order or kind.order
    if first is None:
        first = (24 if kind.name == "pcap" else 0) if not start else None
        if first is None:
            reach = min(size, start + (RUN + 1) * MOST_SOUGHT)
            f.seek(start)
            found = _sought(f.read(reach - start), kind, order, reach == size)
            first = stop if found is None else start + found
    if start:
        tape = Tape(f, first)
    else:
        tape.skip(first)
    out, unknown = Walked(first, first, assumed=order, order=order), Section(order)
    if kind.name == "pcap":
        for _, link, _, _ in _pcap_records(tape, kind, stop):
            out.n += 1
        out.first_link = kind.link
    else:
        seen = _Simple(tape, unknown, stop)
        for _, link, _, _ in seen.records():
            out.first_link = link if not out.n else out.first_link
            out.n += 1
        out.simple, out.order, out.began, out.interfaces = seen.early, unknown.order, unknown.began, unknown.interfaces
        out.names = unknown.names
    out.next = tape.at
    out.cut = tape.ahead(1) or tape.f.cut if isinstance(tape.f, Unpacked) else tape.at < stop
    if isinstance(tape.f, Unpacked):  # its places are those of the unpacked bytes: no other range has any
        out.next = 1 << 62
    return out


class _Simple:
    """Walks blocks whose section may have begun before, and counts the simple packet blocks before any interface of its own."""

    def __init__(self, tape: Tape, section: Section, stop: float) -> None:
        self.tape, self.section, self.stop, self.early = tape, section, stop, 0

    def records(self) -> Iterator[Record]:
        while self.tape.at < self.stop:
            before = self.tape.at
            if self.tape.ahead(4) and not self.section.began and not self.section.interfaces:
                (block,) = struct.unpack_from(self.section.order + "I", self.tape.held, self.tape.pos)
                early = block == SIMPLE
            else:
                early = False
            yield from _pcapng_records(self.tape, self.section, before + 1)  # one block
            if self.tape.at == before:
                return
            self.early += early


def meet(sizes: dict[str, int], split_bytes: int, walk: Callable[[list[tuple]], list[Walked]]) -> dict[str, list[Walked]]:
    """The ranges of each file, walked until each begins where the one before ends. walk takes (file, size, start, stop, first,
    order) rows. Each round sets at least one more range of a file right, and usually all."""
    cuts = {file: [(a, min(a + split_bytes, size)) for a in range(0, size, split_bytes)] for file, size in sizes.items()}
    todo = [(file, sizes[file], a, b, None, None) for file, own in cuts.items() for a, b in own]
    found: dict[tuple[str, int], Walked] = {}
    while todo:
        for row, got in zip(todo, walk(todo)):
            found[row[0], row[2]] = got
        todo = []
        for file, own in cuts.items():
            last = found[file, 0]
            for a, b in own[1:]:
                if last.cut:  # nothing behind it is read
                    break
                now = found[file, a]
                if last.next >= b:  # the records before reach beyond this range
                    found[file, a] = now = Walked(last.next, last.next, assumed=last.order, order=last.order)
                elif now.first != last.next or now.assumed != last.order:
                    todo.append((file, sizes[file], a, b, last.next, last.order))
                last = now
    return {file: [found[file, a] for a, _ in own] for file, own in cuts.items()}


@dataclass
class Part:
    """A range to read: its records' begin and end, the frames before it, and the section it begins in."""

    file: str
    first: int
    stop: int
    frames: int
    order: str
    interfaces: list[tuple[int, int, str]]


def parts(file: str, walked: list[Walked]) -> tuple[list[Part], int]:
    """The ranges with records of a file, and its number of records. A cut record ends the capture."""
    out, frames, interfaces, order = [], 0, [], walked[0].order if walked else "<"
    for w in walked:
        n = w.n + (w.simple if interfaces else 0)
        if n:
            out.append(Part(file, w.first, w.next, frames, order, list(interfaces)))
        frames += n
        interfaces = w.interfaces if w.began else interfaces + w.interfaces
        order = w.order
        if w.cut:
            break
    return out, frames


def opened(path: str):
    """A file for reading at any place, by the path that Spark gives it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _can_open(path: str) -> bool:
    try:
        opened(path).close()
    except (OSError, ValueError, pa.ArrowException):
        return False
    return True


_RANGE = "k int, file string, size long, start long, stop long, first long, order string"
_WALKED = "k int, first long, next long, n long, simple long, assumed string, order string, began boolean, interfaces array<struct<link:int,per_second:long,name:string>>, first_link int, cut boolean, names array<string>, error string"
_WALKED_TYPES = pa.schema([
    ("k", pa.int32()), ("first", pa.int64()), ("next", pa.int64()), ("n", pa.int64()), ("simple", pa.int64()), ("assumed", pa.string()), ("order", pa.string()), ("began", pa.bool_()),
    ("interfaces", pa.list_(pa.struct([("link", pa.int32()), ("per_second", pa.int64()), ("name", pa.string())]))), ("first_link", pa.int32()), ("cut", pa.bool_()), ("names", pa.list_(pa.string())), ("error", pa.string()),
])


def _walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with opened(r["file"]) as f:
                try:
                    w = walk_range(f, r["size"], r["start"], r["stop"], r["first"], r["order"]).__dict__ | {"error": None}
                except CaptureError as e:
                    w = Walked(r["size"], r["size"]).__dict__ | {"error": str(e)}
            w["interfaces"] = [dict(zip(("link", "per_second", "name"), i)) for i in w["interfaces"]]
            yield pa.RecordBatch.from_pylist([{"k": r["k"], **w}], _WALKED_TYPES)


def _walker(spark: SparkSession, errors: dict[str, str]) -> Callable[[list[tuple]], list[Walked]]:
    """Walks ranges on Spark, one task each; a few numbers of each come back, as of the splits of any scan."""

    def walk(rows: list[tuple]) -> list[Walked]:
        ranges = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], _RANGE).repartition(len(rows))
        out: list[Walked] = [Walked(0, 0)] * len(rows)
        for r in ranges.mapInArrow(_walk_rows, _WALKED).collect():
            if r.error:
                errors[rows[r.k][0]] = r.error
            out[r.k] = Walked(r.first, r.next, r.n, r.simple, r.assumed, r.order, r.began, [tuple(i) for i in r.interfaces], r.first_link, r.cut, list(r.names))
        return out

    return walk


class Files:
    """The capture files at a path: those that are walked by ranges, and the others."""

    def __init__(self, spark: SparkSession, path: str, split_bytes: int | None = None) -> None:
        """split_bytes None: a core's share of all bytes, within LEAST_SPLIT and SPLIT_BYTES."""
        self.spark = spark
        self.all = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size_bytes"), "content")
        if split_bytes is None:
            share = (self.all.agg(F.sum("size_bytes")).first()[0] or 0) // spark.sparkContext.defaultParallelism
            split_bytes = min(SPLIT_BYTES, max(LEAST_SPLIT, share))
        self.split_bytes = split_bytes
        large = [(r.file, r.size_bytes) for r in self.all.where(F.col("size_bytes") > split_bytes).select("file", "size_bytes").collect()]
        stores: dict[str, bool] = {}
        for file, _ in large:
            stores.setdefault(file.partition(":")[0], _can_open(file))
        self.large = {file: size for file, size in large if stores[file.partition(":")[0]]}
        self.errors: dict[str, str] = {}
        self._walked: dict[str, list[Walked]] | None = None

    @property
    def walked(self) -> dict[str, list[Walked]]:
        if self._walked is None:
            self._walked = meet(self.large, self.split_bytes, _walker(self.spark, self.errors)) if self.large else {}
        return self._walked

    @property
    def small(self) -> DataFrame:
        """The files that one task reads."""
        if not self.large:
            return self.all
        taken = self.spark.createDataFrame([(f,) for f in self.large], "taken string")
        return self.all.where(F.col("size_bytes") <= self.split_bytes).unionByName(self.all.where(F.col("size_bytes") > self.split_bytes).join(taken, F.col("file") == F.col("taken"), "left_anti"))


def _rows(file: str, found: Iterator[Record], frames: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Dissected batches of records; frames were before them, and no frame above `most` is read."""
    held: list[Record] = []
    for record in found:
        if most is not None and frames + len(held) >= most:
            break
        held.append(record)
        if len(held) == BATCH:
            yield packet_batch(file, frames + 1, held)
            frames, held = frames + len(held), []
    if held:
        yield packet_batch(file, frames + 1, held)


def read_packets(spark: SparkSession, path: str, max_packets: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """Packet rows of the capture files at path; frame counts from 1 in each file. max_packets stops each file early."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield from _rows(file, records(content.as_py()), 0, max_packets)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                with opened(p["file"]) as f:
                    tape = _tape(f)
                    kind = _kind(tape)
                    if isinstance(tape.f, Unpacked):
                        tape.skip(p["first"])
                    else:
                        tape = Tape(f, p["first"])
                    section = Section(p["order"], [(i["link"], i["per_second"], i["name"]) for i in p["interfaces"]])
                    yield from _rows(p["file"], _walk(tape, kind, section, p["stop"]), p["frames"], max_packets)

    files = Files(spark, path, split_bytes)
    found = files.small.select("file", "content").mapInArrow(whole, PACKET_SCHEMA)
    pieces = [p for file, walked in files.walked.items() for p in parts(file, walked)[0] if max_packets is None or p.frames < max_packets]
    if pieces:
        schema = "file string, first long, stop long, frames long, order string, interfaces array<struct<link:int,per_second:long,name:string>>"
        spread = spark.createDataFrame([(p.file, p.first, p.stop, p.frames, p.order, p.interfaces) for p in pieces], schema).repartition(len(pieces))
        found = found.unionByName(spread.mapInArrow(ranged, PACKET_SCHEMA))
    return found


def packets_from_frames(frames: DataFrame) -> DataFrame:
    """Packet rows of frames(file, frame, ts_us, linktype, raw), from whatever source has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                us, links, raws = (batch.column(c).to_pylist() for c in ("ts_us", "linktype", "raw"))
                found = packet_batch("", 0, [(t * 1000, link, raw or b"", len(raw or b"")) for t, link, raw in zip(us, links, raws)])
                yield found.set_column(0, "file", batch.column("file")).set_column(1, "frame", batch.column("frame").cast(pa.int64()))

    return frames.select("file", "frame", "ts_us", "linktype", "raw").mapInArrow(run, PACKET_SCHEMA)


# -- what captures say of themselves -----------------------------------------------------------------------------------------


def _summary(kind: Kind, packed: bool, n: int, walked: list[Walked]) -> dict:
    names = [name for w in walked for name in w.names]
    links = [w.first_link for w in walked if w.first_link >= 0] + [i[0] for w in walked for i in w.interfaces] + ([kind.link] if kind.name == "pcap" else [])
    cut = any(w.cut for w in walked)
    notes = ["gzip-compressed capture"] * packed + ["the capture ends inside a record"] * cut
    return {"format": kind.name, "detail": kind.detail, "packet_count": n, "linktype": LINKTYPES.get(links[0], f"linktype {links[0]}") if links else "linktype -1", "interfaces": names, "truncated": cut, "notes": notes}


def structure(data: bytes) -> dict:
    """What a capture's blocks say of it: format, link type, interfaces, records, whether it was cut, notes."""
    packed, kind = data[:2] == GZIP, _kind(_tape(io.BytesIO(data)))
    w = walk_range(io.BytesIO(data), len(data), 0, len(data))
    return _summary(kind, packed, w.n, [w])


_META = "file string, size_bytes long, format string, detail string, packet_count long, linktype string, interfaces array<string>, truncated boolean, notes array<string>"


def _no_capture(why: str) -> dict:
    return {"format": "", "detail": "", "packet_count": 0, "linktype": "", "interfaces": [], "truncated": False, "notes": [why]}


def capture_meta(spark: SparkSession, path: str, max_packets: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """One row per capture file; a file that is no capture has its error in notes. A file that max_packets stops says so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema(
            [("file", pa.string()), ("size_bytes", pa.int64()), ("format", pa.string()), ("detail", pa.string()), ("packet_count", pa.int64()), ("linktype", pa.string()), ("interfaces", pa.list_(pa.string())), ("truncated", pa.bool_()), ("notes", pa.list_(pa.string()))]
        )
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    found = structure(row["content"])
                except CaptureError as e:
                    found = _no_capture(str(e))
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "size_bytes": row["size_bytes"], **found}], types)

    files = Files(spark, path, split_bytes)
    out = files.small.mapInArrow(run, _META)
    rows = []
    for file, walked in files.walked.items():
        if file in files.errors:
            found = _no_capture(files.errors[file])
        else:
            with opened(file) as f:
                tape = _tape(f)
                found = _summary(_kind(tape), isinstance(tape.f, Unpacked), parts(file, walked)[1], walked)
        rows.append((file, files.large[file], *(found[c] for c in ("format", "detail", "packet_count", "linktype", "interfaces", "truncated", "notes"))))
    out = out.unionByName(spark.createDataFrame(rows, _META)) if rows else out
    if max_packets is not None:
        stopped = F.col("packet_count") >= max_packets
        note = F.array(F.lit(f"analysis stopped early at --max-packets={max_packets}"))
        out = out.withColumn("notes", F.when(stopped, F.concat("notes", note)).otherwise(F.col("notes"))).withColumn("packet_count", F.least("packet_count", F.lit(max_packets)))
    return out
