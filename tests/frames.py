"""Captures from raw bytes."""

import socket
import struct

CLIENT, SERVER, BASE = "10.0.0.5", "93.184.216.34", 1755400000.0
MAC_C, MAC_S = bytes.fromhex("080027111111"), bytes.fromhex("080027222222")
FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}


def ether(kind, body, src=MAC_C, dst=MAC_S):
    return dst + src + struct.pack(">H", kind) + body


def ipv4(src, dst, proto, body, ident=1, ttl=64):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), ident, 0, ttl, proto, 0, socket.inet_aton(src), socket.inet_aton(dst)) + body


def tcp(src, sport, dst, dport, flags, seq=0, payload=b"", **ip):
    head = struct.pack(">HHIIBBHHH", sport, dport, seq % 2**32, 0, 0x50, sum(FLAGS[f] for f in flags), 8192, 0, 0)
    return ether(0x0800, ipv4(src, dst, 6, head + payload, **ip))


def udp(src, sport, dst, dport, payload, **ip):
    return ether(0x0800, ipv4(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload, **ip))


def icmp(src, dst, kind, payload):
    return ether(0x0800, ipv4(src, dst, 1, struct.pack(">BBHHH", kind, 0, 0, 1, 1) + payload))


def arp(op, sender_mac, sender, target):
    return ether(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + sender_mac + socket.inet_aton(sender) + b"\0" * 6 + socket.inet_aton(target), src=sender_mac)


def name(n):
    return b"".join(bytes([len(x)]) + x.encode() for x in n.split(".")) + b"\0"


QT = {"A": 1, "TXT": 16, "AAAA": 28}


def dns(n, qtype="A", answers=(), rcode=0, response=None, ttl=300):
    response = bool(answers) or rcode > 0 if response is None else response
    out = struct.pack(">HHHHHH", 7, (0x8180 if response else 0x0100) | rcode, 1, len(answers), 0, 0) + name(n) + struct.pack(">HH", QT[qtype], 1)
    for a in answers:
        data = socket.inet_aton(a) if qtype == "A" else bytes([len(a)]) + a.encode()
        out += b"\xc0\x0c" + struct.pack(">HHIH", QT[qtype], 1, ttl, len(data)) + data
    return out


def conversation(c2s, s2c, cport=44000, port=80, client=CLIENT, server=SERVER, t=BASE, close=True, size=1400, again=None):
    """(time, frame) of a TCP connection: handshake, data in segments, close. again: the segment that is sent twice."""
    out, cseq, sseq = [], 1000, 5000

    def add(from_client, flags, seq, payload=b""):
        a, b = ((client, cport), (server, port)) if from_client else ((server, port), (client, cport))
        out.append((t + 0.0007 * len(out), tcp(*a, *b, flags, seq, payload)))

    add(True, "S", cseq)
    add(False, "SA", sseq)
    add(True, "A", cseq + 1)
    for from_client, data in ((True, c2s), (False, s2c)):
        for k in range(0, len(data), size):
            for _ in range(2 if again == k // size and from_client else 1):
                add(from_client, "PA", (cseq if from_client else sseq) + 1 + k, data[k : k + size])
    if close:
        add(True, "FA", cseq + 1 + len(c2s))
        add(False, "FA", sseq + 1 + len(s2c))
    return out


def pcap(frames, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)]
    for t, raw in sorted(frames, key=lambda x: x[0]):
        sec = int(t)
        out.append(struct.pack(order + "IIII", sec, round((t - sec) * (1e9 if nano else 1e6)), len(raw), len(raw)) + raw)
    return b"".join(out)


def pcapng(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HH", 2, 4) + b"eth0" + b"\0\0\0\0")
    for t, raw in frames:
        us = round(t * 1e6)
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(raw), len(raw)) + raw)
    return out


def client_hello(sni="www.example.org", alpn=b"\x02h2"):
    ext = lambda kind, data: struct.pack(">HH", kind, len(data)) + data
    host = sni.encode()
    exts = ext(0, struct.pack(">HBH", len(host) + 3, 0, len(host)) + host) + ext(10, struct.pack(">HHH", 4, 29, 23)) + ext(11, b"\x01\x00") + ext(16, alpn) + ext(43, b"\x04\x03\x04\x03\x03")
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + struct.pack(">HHH", 4, 0x1301, 0x0A0A) + b"\x01\0" + struct.pack(">H", len(exts)) + exts
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello


def der(tag, value):
    n = len(value)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + value


def der_name(cn):
    return der(0x30, der(0x31, der(0x30, der(6, b"\x55\x04\x03") + der(0x0C, cn.encode()))))


def cert(cn="shop.example", issuer="Test CA", nested=True):
    fields = der(0xA0, der(2, b"\x02")) + der(2, b"\x01") + der(0x30, b"") + der_name(issuer) + der(0x30, der(0x17, b"240101000000Z") + der(0x17, b"340101000000Z")) + der_name(cn) + der(0x30, b"")
    return der(0x30, der(0x30, fields) if nested else fields)


def dhcp(kind, host="lab-pc", yiaddr="0.0.0.0", op=1):
    head = struct.pack(">BBBBIHH4s4s4s4s", op, 1, 6, 0, 1, 0, 0, b"\0" * 4, socket.inet_aton(yiaddr), b"\0" * 4, b"\0" * 4) + MAC_C + b"\0" * 202
    return head + b"\x63\x82\x53\x63" + bytes([53, 1, kind, 12, len(host)]) + host.encode() + bytes([50, 4]) + socket.inet_aton("10.0.0.77") + b"\xff"
