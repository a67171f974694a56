"""TCP reassembly with windows: no per-stream Python.

A segment's relative sequence number counts from its direction's base, modulo 2**32. Of equal numbers the longest
segment stays; each of the rest gives the bytes beyond the furthest end before it. Spark shuffles by stream and
sorts; a long stream spills like any window. A stream stays in pieces, which parsers read forward; only what asks for a
whole side puts it together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .feeds import WHO
from .limits import Limits
from .numbering import running

STREAM = ("file", "low", "high")
ENDS = ("client", "client_port", "server", "server_port")
TIMES = ("start_ts", "end_ts", "first_frame", "packets", "handshake", "terminated_cleanly")


def chunks(segments: DataFrame, key: list[str], most_bytes: int | None = Limits.stream_bytes) -> DataFrame:
    """key, rel, start, chunk, gap, left_out over segments(key..., frame, seq, base, payload): what each adds to its direction.

    gap is 1 where bytes are missing before the segment. Where a direction has most_bytes, chunk is null, and
    left_out is the number of its bytes.
    """
    rel = F.expr("pmod(seq - base, 4294967296L)")
    w = Window.partitionBy(*key)
    best = segments.withColumn("rel", rel).withColumn("len", F.octet_length("payload"))
    best = best.where("len > 0").withColumn("k", F.row_number().over(w.partitionBy(*key, "rel").orderBy(F.col("len").desc(), "frame"))).where("k = 1")
    before = w.orderBy("rel").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max(F.col("rel") + F.col("len")).over(before)
    out = best.withColumn("cur", F.coalesce(reached, F.lit(0)))
    skip = F.greatest(F.col("cur") - F.col("rel"), F.lit(0))
    fresh = F.greatest(F.col("len") - skip, F.lit(0)).cast("long")
    out = out.withColumns({"start": F.col("rel") + skip, "fresh": fresh}).withColumn("held", F.sum("fresh").over(w.orderBy("rel")) - F.col("fresh"))
    kept = F.lit(True) if most_bytes is None else F.col("held") < most_bytes
    chunk = F.expr("substring(payload, CAST(greatest(cur - rel, 0) + 1 AS INT))")
    gap = F.when(kept, (F.col("rel") > F.col("cur")).cast("int")).otherwise(0)
    return out.select(*key, "rel", "start", F.when(kept, chunk).alias("chunk"), gap.alias("gap"), F.when(kept, F.lit(0).cast("long")).otherwise(F.col("fresh")).alias("left_out"))


def segments(packets: DataFrame) -> DataFrame:
    """TCP segments with their stream, its ends, their direction and its base sequence number. One shuffle, by stream."""
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    tcp = packets.where("proto = 'tcp'").withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}).repartition(*STREAM)
    opener = F.struct("frame", F.col("src").alias("client"), F.col("sport").alias("client_port"), F.col("dst").alias("server"), F.col("dport").alias("server_port"))
    j = tcp.withColumn("e", F.min(opener).over(Window.partitionBy(*STREAM))).withColumn("c2s", (F.col("src") == F.col("e.client")) & (F.col("sport") == F.col("e.client_port")))
    syn, ack = F.col("tcp_flags").contains("S"), F.col("tcp_flags").contains("A")
    own_base = F.when((syn & ~ack & F.col("c2s")) | (syn & ack & ~F.col("c2s")), F.expr("pmod(tcp_seq + 1, 4294967296L)")).when(F.col("payload_len") > 0, F.col("tcp_seq"))
    first = F.min(F.when(own_base.isNotNull(), F.struct("frame", own_base.alias("base")))).over(Window.partitionBy(*STREAM, "c2s"))
    return j.withColumn("base", first["base"])


def stream_table(packets: DataFrame) -> DataFrame:
    """One narrow row per TCP stream: its key, index by start within its capture, endpoints, times, handshake and clean end."""
    segs = segments(packets.drop("payload"))
    syn, ack, fin = (F.col("tcp_flags").contains(x) for x in "SAF")
    info = segs.groupBy(*STREAM).agg(
        F.first("e").alias("e"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("packets"),
        (F.max(syn & ~ack & F.col("c2s")) & F.max(syn & ack & ~F.col("c2s"))).alias("handshake"), (F.max(fin & F.col("c2s")) & F.max(fin & ~F.col("c2s"))).alias("terminated_cleanly"),
    )
    numbered = running(info, ["file"], F.col("start_ts"), ["start_ts", "first_frame"], {"number": F.lit(1)})
    return numbered.select(*STREAM, (F.col("number") - 1).cast("int").alias("index"), *[f"e.{c}" for c in ENDS], *TIMES)


def stream_chunks(packets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The bytes of each stream in pieces, with the stream's columns: its rows are consecutive in one partition, the client's side
    in order of `start`, then the server's. A stream without bytes has one row."""
    data = segments(packets).where("payload_len > 0").select(*STREAM, "c2s", "frame", F.col("tcp_seq").alias("seq"), "base", "payload")
    pieces = chunks(data, [*STREAM, "c2s"], limits.stream_bytes)
    side = F.when(F.col("c2s"), "c2s").otherwise("s2c").alias("side")
    joined = stream_table(packets).join(pieces.select(*STREAM, side, "start", "chunk", "gap", "left_out"), list(STREAM), "left").drop("low", "high")
    return joined.repartition("file", "index").sortWithinPartitions("file", "index", "side", "start")


ASSEMBLED = (
    "file string, index int, client string, client_port int, server string, server_port int, start_ts double, end_ts double, first_frame long, packets long, handshake boolean, terminated_cleanly boolean, "
    "gaps int, left_out long, c2s binary, s2c binary"
)
_TYPES = pa.schema(
    [("file", pa.string()), ("index", pa.int32()), ("client", pa.string()), ("client_port", pa.int32()), ("server", pa.string()), ("server_port", pa.int32()), ("start_ts", pa.float64()), ("end_ts", pa.float64()), ("first_frame", pa.int64()), ("packets", pa.int64()), ("handshake", pa.bool_()), ("terminated_cleanly", pa.bool_()), ("gaps", pa.int32()), ("left_out", pa.int64()), ("c2s", pa.binary()), ("s2c", pa.binary())]
)


def assembled(pieces: DataFrame) -> DataFrame:
    """Streams with the bytes of each side put together, of pieces as stream_chunks gives them. For what needs a whole side at
    once: a row holds up to twice limits.stream_bytes."""
    who = (*WHO[:-1], *TIMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, row, sides = None, {}, {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([row | {c: b"".join(sides[c]) for c in ("c2s", "s2c")}], _TYPES)

        for batch in batches:
            values = zip(*(batch.column(c).to_pylist() for c in who))
            for of, side, chunk, gap, out in zip(values, batch.column("side").to_pylist(), batch.column("chunk"), batch.column("gap").to_pylist(), batch.column("left_out").to_pylist()):
                if of[:2] != last:
                    if last is not None:
                        yield done()
                    last, row, sides = of[:2], dict(zip(who, of)) | {"gaps": 0, "left_out": 0}, {"c2s": [], "s2c": []}
                if side is not None:
                    row["gaps"] += gap
                    row["left_out"] += out
                    sides[side].append(chunk.as_py() or b"")
        if last is not None:
            yield done()

    return pieces.select(*who, "side", "chunk", "gap", "left_out").mapInArrow(run, ASSEMBLED)


def streams(packets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per TCP stream: index by start, endpoints, times, handshake, clean end, gaps, and the bytes each way."""
    return assembled(stream_chunks(packets, limits))
