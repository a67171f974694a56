"""Streams read forward in pieces give what whole sides give, and memory stays bounded."""

import random
import resource

import frames as fr
import pytest
from pyspark.sql import functions as F

from wirelens.operators import app, covert, detectors, extract
from wirelens.operators.feeds import Feed
from wirelens.operators.limits import Limits
from wirelens.operators.numbering import running
from wirelens.plans.analysis import Analysis


def pieces(data, seed):
    """data in pieces of random sizes."""
    rng, at = random.Random(seed), 0
    while at < len(data):
        n = rng.choice([1, 1, 2, 3, 7, 50, 1000])
        yield data[at : at + n]
        at += n


def test_feed_against_bytes():
    rng = random.Random(4)
    for seed in range(300):
        data = bytes(rng.choice(b"ab\r\n") for _ in range(rng.randrange(60)))
        feed, at = Feed(pieces(data, seed)), 0
        for _ in range(12):
            step = rng.randrange(5)
            if step == 0:
                what = rng.choice([b"\r\n", b"a", b"\r\n\r\n", b"ab"])
                start = rng.randrange(3)
                want = data.find(what, at + start)
                assert feed.find(what, None, start) == (want - at if want >= 0 else -1)
            elif step == 1:
                n, keep = rng.randrange(9), rng.choice([None, 0, 3])
                part = data[at : at + n]
                assert feed.take(n, keep) == (part if keep is None else part[:keep], len(part))
                at += len(part)
            elif step == 2:
                n = rng.randrange(9)
                assert feed.peek(n) == data[at : at + n]
            elif step == 3:
                found = data.find(b"\r\n", at)
                assert feed.past(b"\r\n") == (found >= 0)
                at = found + 2 if found >= 0 else len(data)
            else:
                most = rng.choice([0, 1, 2])
                lines = list(feed.lines(most))
                rest = data[at:].split(b"\r\n")
                assert lines == rest[:most]
                at = min(len(data), at + sum(len(x) + 2 for x in rest[:most]))
        longest = rng.randrange(1, 6)
        assert list(Feed(pieces(data, seed)).lines(None, longest)) == [x[:longest] for x in data.split(b"\r\n")]


def http_bytes(seed):
    rng, out = random.Random(seed), b""
    for k in range(rng.randrange(5)):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 40, 3000])))
        kind = rng.randrange(4)
        if kind == 0:
            framed, head = body, b"Content-Length: %d\r\n" % len(body)
        elif kind == 1:
            framed, head = b"".join(b"%x;q=1\r\n%s\r\n" % (len(c), c) for k in range(0, len(body), 700) if (c := body[k : k + 700])) + b"0\r\nT: 1\r\n", b"Transfer-Encoding: chunked\r\n"
        else:
            framed, head = b"", rng.choice([b"", b"X: y\r\n"])
        out += b"POST /%d HTTP/1.1\r\nHost: h\r\n%s\r\n%s" % (k, head, framed)
    return out[: rng.randrange(len(out) + 1)] if out and rng.random() < 0.5 else out + rng.choice([b"", b"rest", b"GET ", b"\xff\xfe"])


def test_http_in_pieces():
    for seed in range(300):
        data = http_bytes(seed)
        whole = [(m[0], h, b) for m, h, b in app.Direction(data, app.REQUEST, False)]
        found = app.Direction(Feed(pieces(data, seed)), app.REQUEST, False, Limits(), 100)
        cut = [(m[0], h, b, found.size) for m, h, b in found]
        assert cut == [(m, h, b[:100], len(b)) for m, h, b in whole]


def test_a_stream_that_is_no_http_is_not_held():
    taken = []

    def endless():
        for k in range(1000):
            taken.append(k)
            yield b"\x16\x03\x01 binary" * 100

    assert list(app.Direction(Feed(endless()), app.REQUEST, False)) == [] and len(taken) == 1
    taken.clear()
    assert list(app.Direction(Feed(endless()), app.RESPONSE, True)) == [] and len(taken) == 1


def test_a_gigabyte_in_bounded_memory():
    """An answer of 1 GB, chunked, and TLS records of 1 GB: parsed whole, little of it held."""
    part = b"x" * (1 << 20)

    def answer():
        yield b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
        for _ in range(1024):
            yield b"100000\r\n"
            yield part
            yield b"\r\n"
        yield b"0\r\n\r\nHTTP/1.1 404 No\r\nContent-Length: 2\r\n\r\nno"

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = app.Direction(Feed(answer()), app.RESPONSE, True, Limits.none(), 1000)
    assert [(m[1], len(b), found.size) for m, _, b in found] == [(b"200", 1000, 1 << 30), (b"404", 2, 2)]
    record = b"\x17\x03\x03\x40\x00" + b"y" * 16384
    tls = Feed(iter([*[record * 64] * 1024, fr.client_hello()]))
    assert [kind for kind, _ in app._handshakes(tls)] == [1]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 << 10  # KiB


@pytest.mark.parametrize("order", ["given", "shuffled"])
def test_numbers_are_gapless(spark, order):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([None, float(rng.randrange(5)), rng.random() * 4, 2.5]), k, rng.randrange(9)) for k in range(400)]
    rng.shuffle(rows) if order == "shuffled" else None
    df = spark.createDataFrame(rows, "file string, ts double, k int, size int").repartition(7)
    got = {r.k: (r.number, r.upto) for r in running(df, ["file"], F.col("ts"), ["ts", "k"], {"number": F.lit(1), "upto": F.col("size")}).collect()}
    for file in "ab":
        number = upto = 0
        for _, ts, k, size in sorted((r for r in rows if r[0] == file), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            number, upto = number + 1, upto + size
            assert got[k] == (number, upto)
    plan = running(df, ["file"], F.col("ts"), ["ts", "k"], {"number": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "Window [sum" in plan and "hashpartitioning(file#" in plan


def many_streams():
    frames, rng = [], random.Random(9)
    for k in range(25):
        size = rng.choice([0, 3, 1400, 9000])
        ask = b"POST /up HTTP/1.1\r\nHost: h\r\nContent-Type: multipart/x\r\nContent-Length: %d\r\n\r\n" % size + bytes(rng.randrange(256) for _ in range(size))
        tell = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % (2 * size) + b"z" * (2 * size)
        frames += fr.conversation(ask * 3, tell * 3, cport=30000 + k, t=fr.BASE + rng.choice([0, 0.2, 5]), size=rng.choice([400, 1400]))
    return frames


def test_limits_are_parameters_and_told(spark, tmp_path):
    (tmp_path / "m.pcap").write_bytes(fr.pcap(many_streams()))
    path = str(tmp_path / "m.pcap")
    whole = Analysis(spark, path, limits=Limits.none())
    rows = {(r.stream, r.n): r for r in whole.http.collect()}
    assert len(rows) == 75 and all(len(r.req_body) == r.req_body_len and len(r.resp_body) == r.resp_body_len == 2 * r.req_body_len and r.note == "" for r in rows.values())
    assert sorted(r["index"] for r in whole.streams.collect()) == list(range(25)) and whole.left_out.count() == 0
    starts = [r.start_ts for r in whole.streams.orderBy("index").collect()]
    assert starts == sorted(starts)
    small = Analysis(spark, path, limits=Limits(messages=2, body=1000, request_body=100, carve=5000))
    cut = {(r.stream, r.n): r for r in small.http.collect()}
    assert set(cut) == {k for k in rows if k[1] < 2}
    for k, r in cut.items():
        assert bytes(r.req_body) == bytes(rows[k].req_body)[:100] and r.req_body_len == rows[k].req_body_len and bytes(r.resp_body) == bytes(rows[k].resp_body)[:1000]
        assert ("request body" in r.note) == (r.req_body_len > 100) and ("messages after the first 2" in r.note) == (k[1] == 1)
    assert {r.what.split(" ", 1)[0] for r in small.left_out.collect()} >= {"messages", "the"}
    short = Analysis(spark, path, limits=Limits(stream_bytes=3000))
    kept = {r["index"]: r for r in short.streams.collect()}
    for s in whole.streams.collect():
        k = kept[s["index"]]
        assert bytes(s.c2s).startswith(bytes(k.c2s)) and len(s.c2s) + len(s.s2c) == len(k.c2s) + len(k.s2c) + k.left_out
        assert len(k.c2s) < 3000 + 1400
    assert short.left_out.where("what LIKE '%bytes of the stream%'").count() == sum(k.left_out > 0 for k in kept.values()) > 0
    for a in (whole, small, short):
        a.close()


def test_pieces_and_sides_agree(spark, tmp_path):
    """Parsers over pieces give what they give over whole sides."""
    (tmp_path / "m.pcap").write_bytes(fr.pcap(many_streams() + fr.conversation(b"USER x\r\nPASS y\r\n" * 3, b"220 a\r\n230 b\r\n", port=21, t=fr.BASE + 9) + fr.conversation(fr.client_hello(), b"", port=443, t=fr.BASE + 10)))
    a = Analysis(spark, str(tmp_path / "m.pcap"))
    whole = a.streams.persist()
    for f in (app.http_transactions, app.tls_sessions, app.credentials, app.banners, app.ftp_commands, app.smtp_traffic, extract.smtp_artifacts):
        assert sorted(map(str, f(whole).collect())) == sorted(map(str, f(a.chunks).collect()))
    assert a.chunks.withColumn("part", F.spark_partition_id()).groupBy("file", "index").agg(F.count_distinct("part").alias("n")).where("n > 1").isEmpty()
    whole.unpersist()
    a.close()


def test_texts_of_long_sides_are_whole(spark, monkeypatch):
    monkeypatch.setattr(extract, "SCAN_BLOCK", 1000)
    monkeypatch.setattr(extract, "SCAN_SHARED", 30)
    data = b"".join(b"%06d" % k for k in range(900))
    s = spark.createDataFrame([("f", 0, "1.1.1.1", 1, "2.2.2.2", 2, 0.0, bytearray(data), bytearray(b""))], "file string, index int, client string, client_port int, server string, server_port int, start_ts double, c2s binary, s2c binary")
    texts = [r.text for r in extract._side_texts(s, None).collect()]
    assert texts[0] + "".join(t[30:] for t in texts[1:]) == data.decode() and all(b.startswith(a[-30:]) for a, b in zip(texts, texts[1:]))
    assert "".join(r.text for r in extract._side_texts(s, 700).collect()) == data[:700].decode()


def test_xor_is_tried_on_whole_blobs():
    rng = random.Random(2)
    for _ in range(60):
        blob = bytearray(rng.randrange(256) for _ in range(rng.randrange(0, 9000)))
        for _ in range(rng.randrange(3)):
            flag = rng.choice(extract.XOR_PREFIXES) + bytes(rng.choice(b"abc{") for _ in range(rng.choice([3, 150, 300]))) + b"}" * rng.randrange(2)
            at, key = rng.randrange(len(blob) + 1), rng.randrange(256)
            blob[at:at] = bytes(c ^ key for c in flag)
        want = []
        for key in range(1, 256):
            plain = bytes(c ^ key for c in blob)
            prefix = next((p for p in extract.XOR_PREFIXES if p in plain), None)
            if prefix:
                at = plain.find(prefix)
                end = plain.find(b"}", at)
                if 0 <= end - at < extract.XOR_REACH and plain[at : end + 1].isascii():
                    want.append((key, plain[at : end + 1].decode()))
        assert extract._xor(bytes(blob)) == want


def test_an_extractor_finds_its_channel(spark, tmp_path, monkeypatch):
    bits = "".join(f"{c:08b}" for c in b"the flag is hidden here")
    frames = [(fr.BASE + k, fr.udp("10.0.0.9", 4000, "10.0.0.1", 9, b"A" if bit == "1" else b"B")) for k, bit in enumerate(bits)]
    (tmp_path / "c.pcap").write_bytes(fr.pcap(frames))
    monkeypatch.setattr(covert, "EXTRACTORS", dict(covert.EXTRACTORS))
    covert.register_extractor("first byte", lambda a: covert._observe(a.packets.where("proto = 'udp'"), "udp", F.col("src"), {"first byte": (F.hex(F.substring("payload", 1, 1)), F.lit(True))}, ["frame"], a.limits.observations))
    a = Analysis(spark, str(tmp_path / "c.pcap"))
    found = a.covert.where("field = 'first byte'").collect()
    assert found and "flag is hidden" in found[0].decoded
    only = covert.observations(a, ["first byte"])
    assert {r.field for r in only.select("field").distinct().collect()} == {"first byte"} and "response TTL class" not in only._jdf.queryExecution().optimizedPlan().toString()
    a.close()


def test_detectors_share_a_plan_and_fail_alone(spark, tmp_path, monkeypatch):
    frames = [(fr.BASE + k * 0.01, fr.tcp("10.0.0.66", 40000 + k, "10.0.0.1", 20 + k, "S")) for k in range(40)]
    (tmp_path / "s.pcap").write_bytes(fr.pcap(frames))
    monkeypatch.setattr(detectors, "DETECTORS", dict(detectors.DETECTORS))
    a = Analysis(spark, str(tmp_path / "s.pcap"))
    actions = []
    keep = Analysis._keep
    monkeypatch.setattr(Analysis, "_keep", lambda self, df: actions.append(df) or keep(self, df))
    assert {r.id for r in a.findings.collect()} == {"scan.syn.10.0.0.66"} and sum(set(df.columns) >= {"severity", "mitre"} for df in actions) == 1
    a.close()
    for name, broken in (("python", lambda a: 1 / 0), ("running", lambda a: a.findings_like.withColumn("title", F.raise_error(F.lit("broken"))))):
        monkeypatch.setattr(detectors, "DETECTORS", {"syn_scan": detectors.detect_syn_scan, name: broken})
        b = Analysis(spark, str(tmp_path / "s.pcap"))
        b.findings_like = detectors.detect_syn_scan(b)
        found = {r.id: r for r in b.findings.collect()}
        assert f"internal.detector-error.{name}" in found and "scan.syn.10.0.0.66" in found
        b.close()
