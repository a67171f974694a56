"""Captures read by ranges give what one walk through them gives."""

import gzip
import io
import random
import struct

import frames as fr
import pytest

from wirelens.sources import pcap
from wirelens.sources.dissect import PACKET_TYPES, dissect, packet_batch


def some_frames(n=40, seed=1):
    rng, out = random.Random(seed), []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 30, 200])))
        out.append((fr.BASE + k / 8, fr.udp("10.0.0.5", 1000 + k, "10.0.0.6", 7, payload) if k % 3 else fr.tcp("10.0.0.5", 1000 + k, "10.0.0.6", 80, "PA", k, payload)))
    return out


def section(frames, order="<", per_second=None, name=b"eth0", simple=0, interfaces=1):
    """A pcapng section in either byte order."""

    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    units = b"" if per_second is None else struct.pack(order + "HH", 9, 1) + bytes([per_second, 0, 0, 0])
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += b"".join(block(1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HH", 2, len(name)) + name.ljust(4, b"\0") + units) for _ in range(interfaces))
    for k, (t, raw) in enumerate(frames):
        us = round(t * 1e6)
        out += block(3, struct.pack(order + "I", len(raw)) + raw) if k < simple else block(6, struct.pack(order + "IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(raw), len(raw)) + raw)
    return out


def holding_a_capture():
    """Payloads that look like records: what is searched for is found in the wrong place first."""
    inner = fr.pcap(some_frames(12, 4))[24:]
    return fr.pcap([(fr.BASE + k, fr.udp("10.0.0.5", 9, "10.0.0.6", 7, inner)) for k in range(5)])


CAPTURES = {
    "micro": fr.pcap(some_frames()),
    "big, nano": fr.pcap(some_frames(), ">", nano=True),
    "cut": fr.pcap(some_frames())[:-7],
    "cut in a header": fr.pcap(some_frames()) + b"\1\2\3",
    "nonsense in the middle": fr.pcap(some_frames(20)) + b"\xff" * 300 + fr.pcap(some_frames(20))[24:],
    "records inside": holding_a_capture(),
    "no records": fr.pcap([]),
    "header cut": fr.pcap([])[:20],
    "pcapng": section(some_frames()),
    "sections": section(some_frames(15)) + section(some_frames(15, 2), ">", 9, b"wlan0") + section(some_frames(9, 3), "<", 0x8A),
    "simple blocks": section(some_frames(12), simple=8) + section(some_frames(12), ">", simple=5, interfaces=0) + section(some_frames(5), simple=5, interfaces=2),
    "pcapng cut": section(some_frames())[:-30],
}


@pytest.mark.parametrize("name", CAPTURES)
def test_any_cut_gives_the_walk(name):
    data = CAPTURES[name]
    want = list(pcap.records(data))
    rounds = []

    def walk(rows):
        rounds.append(len(rows))
        return [pcap.walk_range(io.BytesIO(data), *r[1:]) for r in rows]

    for split in [*range(1, 40), *range(40, len(data), 97), len(data), len(data) + 1]:
        walked = pcap.meet({"f": len(data)}, split, walk)["f"]
        pieces, n = pcap.parts("f", walked)
        got = []
        for p in pieces:
            assert p.frames == len(got)
            tape = pcap.Tape(io.BytesIO(data), p.first)
            got += pcap._walk(tape, pcap._kind(pcap._tape(io.BytesIO(data))), pcap.Section(p.order, list(p.interfaces)), p.stop)
        assert got == want and n == len(want), split
        assert any(w.cut for w in walked) == pcap.structure(data)["truncated"]
    if name in ("micro", "big, nano", "pcapng"):
        rounds.clear()
        pcap.meet({"f": len(data)}, 1000, walk)
        assert len(rounds) == 1  # every begin was found at once


def test_gzip_members_and_padding():
    whole = fr.pcap(some_frames())
    half = len(whole) // 2
    packed = gzip.compress(whole[:half]) + b"\0" * 9 + gzip.compress(whole[half:]) + b"\0" * 100
    assert list(pcap.records(packed)) == list(pcap.records(whole)) and not pcap.structure(packed)["truncated"]
    early = gzip.compress(whole)[:-20]
    assert pcap.structure(early)["truncated"] and 0 < len(list(pcap.records(early))) <= 40
    walked = pcap.meet({"f": len(packed)}, 64, lambda rows: [pcap.walk_range(io.BytesIO(packed), *r[1:]) for r in rows])["f"]
    pieces, n = pcap.parts("f", walked)
    assert n == 40 and len(pieces) == 1
    stored = gzip.compress(whole, 0)  # unpacked it is shorter than the file
    walked = pcap.meet({"f": len(stored)}, 64, lambda rows: [pcap.walk_range(io.BytesIO(stored), *r[1:]) for r in rows])["f"]
    assert pcap.parts("f", walked)[1] == 40


def test_sizes_that_no_record_has():
    head = fr.pcap([])
    for held in (0xFFFFFFFF, pcap.MOST_RECORD + 1):
        data = head + struct.pack("<IIII", 1, 0, held, held) + b"x" * 50
        assert list(pcap.records(data)) == [] and pcap.structure(data)["truncated"]


def rows_of(spark, path, **how):
    return sorted(map(tuple, pcap.read_packets(spark, path, **how).collect()), key=lambda r: (r[0], r[1]))


def test_large_files_on_many_tasks(spark, tmp_path):
    """Ranges, a gzip file, a broken file and a small one side by side, with spaces in the path."""
    folder = tmp_path / "some captures"
    folder.mkdir()
    (folder / "a.pcap").write_bytes(fr.pcap(some_frames(300)))
    (folder / "b.pcapng").write_bytes(CAPTURES["sections"])
    (folder / "c.pcap.gz").write_bytes(gzip.compress(fr.pcap(some_frames(60)), 0))
    (folder / "d.txt").write_bytes(b"no capture " * 900)
    (folder / "e.pcap").write_bytes(fr.pcap(some_frames(3)))
    path = f"{folder}/a*"
    whole = rows_of(spark, path)
    assert whole == rows_of(spark, path, split_bytes=1500) and len(whole) == 300
    assert pcap.read_packets(spark, path, split_bytes=1500).select("file").rdd.getNumPartitions() > 10
    assert rows_of(spark, path, split_bytes=1500, max_packets=77) == whole[:77]
    for name in ("b.pcapng", "c.pcap.gz", "e.pcap"):
        assert rows_of(spark, f"{folder}/{name}") == rows_of(spark, f"{folder}/{name}", split_bytes=1500)
    meta = {split: sorted(map(str, pcap.capture_meta(spark, str(folder), split_bytes=split).collect())) for split in (1500, 1 << 20)}
    assert meta[1500] == meta[1 << 20] and "no capture" in meta[1500][3]
    noted = {r.file[-6:]: (r.packet_count, r.notes) for r in pcap.capture_meta(spark, str(folder), 50, 1500).collect()}
    assert noted["a.pcap"] == (50, ["analysis stopped early at --max-packets=50"]) and noted["e.pcap"] == (3, [])


def test_columns_and_single_frames_agree():
    rng, frames = random.Random(8), []
    base = [
        fr.tcp("10.0.0.5", 1, "10.0.0.6", 53, "PA", 2**32 - 1, b"\0\x1d" + fr.dns("a.example")), fr.udp("10.0.0.5", 53, "10.0.0.6", 2, fr.dns("b.example", answers=["1.2.3.4"])), fr.udp("1.2.3.4", 53, "5.6.7.8", 53, b""),
        fr.icmp("10.0.0.5", "10.0.0.6", 8, b"ping"), fr.arp(1, fr.MAC_C, "10.0.0.9", "10.0.0.5"), fr.ether(0x86DD, b"\x60" + b"\0" * 60), b"", b"\1" * 13, fr.tcp("9.9.9.9", 65535, "0.0.0.0", 0, "FSRPAU", 7, b"x" * 2000),
    ]
    for raw in base:
        frames += [(1, raw), (101, raw[14:]), (113, raw), (0, b"\2\0\0\0" + raw[14:]), (7, raw), (1, raw[:12] + b"\x81\0\0\1" + raw[12:])]
        for _ in range(150):
            cut = bytearray(raw[: rng.randrange(len(raw) + 1)] if rng.random() < 0.5 else raw)
            for _ in range(rng.randrange(4)):
                if cut:
                    cut[rng.randrange(min(len(cut), 60))] = rng.randrange(256)
            frames.append((1, bytes(cut)))
    got = packet_batch("f", 5, [(k * 1_000_000_007, link, raw, 9) for k, (link, raw) in enumerate(frames)]).to_pylist()
    want = [{"file": "f", "frame": 5 + k, "ts": k * 1_000_000_007 / 1e9, "ts_us": k * 1_000_000_007 // 1000, "frame_len": 9, **dissect(link, raw)} for k, (link, raw) in enumerate(frames)]
    assert got == [{c: r[c] for c in PACKET_TYPES.names} for r in want]
    assert packet_batch("f", 1, []).num_rows == 0
