"""What traffic carried: files, encoded strings, secrets."""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import re
import string
import urllib.parse
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StringType

from ..batches import map_batches, portions
from ..functions import text
from ..sources.rules import Rule
from . import rules as ruleops
from .feeds import Feed, as_chunks, parsed
from .limits import Limits
from .numbering import running

# The longest flag looked for under XOR, and the encodings undone one after the other.
XOR_REACH, CHAIN_DEPTH = 200, 3
#: Bytes of a text that rules are tried on at a time, and those that two such texts of one stream share.
SCAN_BLOCK, SCAN_SHARED = 2 << 20, 64 << 10
XOR_PREFIXES = (b"flag{", b"FLAG{", b"picoCTF{", b"CTF{", b"HTB{", b"THM{")
_XOR_STEPS = [(p, bytes(a ^ b for a, b in zip(p, p[1:]))) for p in XOR_PREFIXES]


# --- files

ARTIFACT_SCHEMA = "file string, stream int, n int, ts double, origin string, client string, server string, name string, claimed_type string, content binary"


def _artifact_columns(df: DataFrame, origin: str, name: Column, claimed: Column, content: Column) -> DataFrame:
    return df.select("file", "stream", "n", "ts", F.lit(origin).alias("origin"), "client", "server", name.alias("name"), claimed.alias("claimed_type"), content.alias("content"))


def http_artifacts(http: DataFrame) -> DataFrame:
    """Bodies of answers, and uploads that name a file."""
    ext = F.create_map(*[F.lit(x) for kv in {"text/html": ".html", "application/json": ".json", "application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "application/zip": ".zip", "text/plain": ".txt"}.items() for x in kv])[F.trim(F.substring_index("content_type_resp", ";", 1))]
    base = F.substring_index("path", "/", -1)
    down_name = F.when(base.contains("."), base).otherwise(F.concat(F.when(base == "", "index").otherwise(base), F.coalesce(ext, F.lit(""))))
    down = _artifact_columns(http.where(F.octet_length("resp_body") > 0), "http-download", down_name, F.col("content_type_resp"), F.col("resp_body"))
    named = F.regexp_extract(F.decode("req_body", "ISO-8859-1"), r'filename="([^"]*)"', 1)
    sent = http.where(F.col("method").isin("POST", "PUT") & (F.octet_length("req_body") > 0)).where((named != "") | F.lower("content_type_req").contains("multipart"))
    return down.unionByName(_artifact_columns(sent, "http-upload", F.when(named != "", named).otherwise("upload"), F.col("content_type_req"), F.col("req_body")))


_DATA = re.compile(rb"(?i)DATA *")


def smtp_artifacts(streams: DataFrame) -> DataFrame:
    """Attachments of mails: what follows DATA up to the lone dot. One mail is held at a time."""
    types = pa.schema([("file", pa.string()), ("stream", pa.int32()), ("n", pa.int32()), ("ts", pa.float64()), ("origin", pa.string()), ("client", pa.string()), ("server", pa.string()), ("name", pa.string()), ("claimed_type", pa.string()), ("content", pa.binary())])

    def mails(feed: Feed) -> Iterator[bytes]:
        while (end := feed.find(b"\r\n")) >= 0:
            line = feed.take(end + 2)[0][:-2].rpartition(b"\n")[2]
            if _DATA.fullmatch(line):
                dot = feed.find(b"\r\n.\r\n")
                if dot < 0:
                    return
                yield feed.take(dot + 5)[0][:-5]

    def attachments(s: dict, sides: Iterator[tuple[str, Feed]]) -> Iterator[dict]:
        n = 0
        for mail in (m for side, feed in sides if side == "c2s" for m in mails(feed)):
            for part in email.message_from_bytes(mail, policy=email.policy.compat32).walk():
                if (name := part.get_filename()) and (content := part.get_payload(decode=True)):
                    yield {"file": s["file"], "stream": s["index"], "n": n, "ts": s["start_ts"], "origin": "smtp-attachment", "client": s["client"], "server": s["server"], "name": name, "claimed_type": part.get_content_type(), "content": content}
                    n += 1

    return parsed(as_chunks(streams).where("server_port IN (25, 587)"), attachments, ARTIFACT_SCHEMA, types, most_rows=1)


@F.pandas_udf(StringType())
def _decomposed(names: pd.Series) -> pd.Series:
    """Accents apart from their letters, as Spark has no function for it."""
    return names.str.normalize("NFKD")


def carved(artifacts: DataFrame, budget: int | None = Limits.carve) -> DataFrame:
    """artifacts with a folder for each capture, number, safe name, size, hashes and type; those beyond a capture's budget
    are marked skipped. Numbers and sums are those of narrow rows; contents meet them after."""
    place = ["file", "stream", "origin", "n"]
    size = F.octet_length("content").cast("long")
    narrow = running(artifacts.select(*place, "ts", "name", size.alias("size")), ["file"], F.col("ts"), ["ts", "stream", "origin", "name", "n"], {"number": F.lit(1), "upto": F.col("size")})
    skipped = F.lit(False) if budget is None else F.col("upto") > budget
    return artifacts.withColumn("size", size).join(narrow.select(*place, "number", "upto"), place).select(
        "file", "stream", "n", "ts", "origin", "client", "server",
        F.concat(text.sanitize_filename(F.col("file")), F.lit("-"), F.substring(F.md5("file"), 1, 8)).alias("folder"),
        F.concat(F.lpad(F.col("number").cast("string"), 4, "0"), F.lit("_"), text.sanitize_filename(_decomposed(F.col("name")))).alias("name"), "claimed_type",
        text.detect_type(F.col("content")).alias("detected_type"), "size", F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"), F.md5("content").alias("md5"), skipped.alias("skipped"), "content",
    )


def write_artifacts(artifacts: DataFrame, folder: str) -> DataFrame:
    """Write contents to a folder that driver and executors share, each under its capture's folder and its safe name; gives
    the path in `folder` and the size of those written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            names, sizes = [], []
            for row in batch.to_pylist():
                name = os.path.join(os.path.basename(row["folder"]), os.path.basename(row["name"]))
                at = os.path.join(folder, name)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part", "wb") as f:
                    f.write(row["content"])
                os.replace(f"{at}.part", at)  # a task that runs twice writes the same file
                names.append(name)
                sizes.append(len(row["content"]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    return artifacts.where(~F.col("skipped")).select("folder", "name", "content").mapInArrow(run, "name string, size long")


# --- encodings

_PRINTABLE = set(string.printable) - set("\x0b\x0c")


def _ratio(s: str) -> float:
    return sum(c in _PRINTABLE for c in s) / len(s) if s else 0.0


def _entropy(s: str) -> float:
    _, n = np.unique(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _unpacked(raw: bytes) -> bytes:
    return zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw


def decode_once(s: str) -> tuple[str, str, str] | None:
    """(encoding, confidence, decoded) of the first encoding that s shows, in the order URL, Base32, Base64, hex."""
    s = s.strip()
    if len(re.findall("%[0-9A-Fa-f]{2}", s)) >= 2 and (plain := urllib.parse.unquote(s)) != s:
        return "URL-encoded", "high", plain
    bare = s.rstrip("=")
    tries = (
        ("Base32", len(bare) >= 8 and len(s) % 8 == 0 and re.fullmatch("[A-Z2-7=]+", s), base64.b32decode),
        ("Base64", len(bare) >= 8 and len(s) % 4 == 0 and re.fullmatch("[A-Za-z0-9+/=]+", s), lambda x: base64.b64decode(x, validate=True)),
        ("Hex", len(s) >= 8 and len(s) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", s), bytes.fromhex),
    )
    for name, looks, decode in tries:
        if not looks:
            continue
        try:
            raw = decode(s)
            if name != "Base32" and raw[:2] == b"\x1f\x8b":
                return f"{name}(gzip)", "high", _unpacked(raw).decode("latin-1")
        except (binascii.Error, ValueError, zlib.error):
            continue
        plain = raw.decode("latin-1")
        if (ratio := _ratio(plain)) > 0.85:
            sure = name != "Base64" or (_entropy(s) > 3.2 and ratio > 0.95)
            return name, "high" if sure else "medium", plain
    return None


def _chain(s: str, depth: int) -> dict:
    steps, now = [], s.strip()
    while len(steps) < depth and (found := decode_once(now)):
        steps.append(found[0])
        now = found[2]
        if _ratio(now) < 0.5:
            break
    final = now if steps else s
    return {"steps": steps, "final": final, "printable": _ratio(final) > 0.9}


def encoding_chains(strings: DataFrame, column: str = "value", depth: int = CHAIN_DEPTH) -> DataFrame:
    """strings with the encodings found one under the other (steps), what is left (final), and whether it is text."""
    schema = T.StructType([*strings.schema.fields, T.StructField("steps", T.ArrayType(T.StringType())), T.StructField("final", T.StringType()), T.StructField("printable", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column):
            found = [_chain(x or "", depth) for x in batch.column(column).to_pylist()]
            new = [pa.array([f[k] for f in found], t) for k, t in (("steps", pa.list_(pa.string())), ("final", pa.string()), ("printable", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "steps", "final", "printable"])

    return map_batches(strings, run, schema)


def _xor(blob: bytes) -> list[tuple[int, str]]:
    """(key, flag) of each one-byte key under which a flag prefix and its closing brace appear: the first such place, of the first
    prefix that appears at all. The whole blob is searched: under any key the XOR of neighbouring bytes is the same, so one
    search for the prefixes' differences finds the places for all keys."""
    data = np.frombuffer(blob, np.uint8)
    if len(data) < 2:
        return []
    steps = (data[1:] ^ data[:-1]).tobytes()
    first: dict[tuple[int, int], int] = {}  # (key, number of the prefix) -> place
    for p, (prefix, wanted) in enumerate(_XOR_STEPS):
        at = steps.find(wanted)
        while at >= 0:
            first.setdefault((blob[at] ^ prefix[0], p), at)
            at = steps.find(wanted, at + 1)
    best: dict[int, int] = {}
    for (key, _), at in sorted(first.items()):
        best.setdefault(key, at)
    found = []
    for key, at in sorted(best.items()):
        plain = (data[at : at + XOR_REACH] ^ np.uint8(key)).tobytes()
        end = plain.find(b"}")
        if key and end >= 0 and plain[: end + 1].isascii():
            found.append((key, plain[: end + 1].decode("ascii")))
    return found


def xor_sweep(blobs: DataFrame, column: str = "data") -> DataFrame:
    """blobs' other columns with key and value for each flag found under a one-byte XOR."""
    others = [c for c in blobs.columns if c != column]
    schema = T.StructType([*blobs.select(*others).schema.fields, T.StructField("key", T.IntegerType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(k, key, value) for k, x in enumerate(batch.column(column)) for key, value in _xor(x.as_py() or b"")]
            at = pa.array([h[0] for h in hits], pa.int64())
            cols = [batch.column(c).take(at) for c in others] + [pa.array([h[1] for h in hits], pa.int32()), pa.array([h[2] for h in hits], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*others, "key", "value"])

    return map_batches(blobs.select(*others, column), run, schema)


# --- secrets


def _side_texts(streams: DataFrame, most: int | None) -> DataFrame:
    """The bytes of each side as texts of at most SCAN_BLOCK, each with the end of the one before; most bytes of a side in all."""
    schema = "ts double, source string, where string, text string"
    types = pa.schema([("ts", pa.float64()), ("source", pa.string()), ("where", pa.string()), ("text", pa.string())])
    arrows = {"c2s": "client→server", "s2c": "server→client"}

    def texts(who: dict, sides: Iterator[tuple[str, Feed]]) -> Iterator[dict]:
        for side, feed in sides:
            left, tail = float("inf") if most is None else most, b""
            while left > 0 and (block := feed.take(min(left, SCAN_BLOCK))[0]):
                source, where = f"TCP stream {who['index']} ({arrows[side]}, port {who['server_port']})", f"reassembled stream ({arrows[side]}); open with: wirelens stream {who['index']}"
                yield {"ts": who["start_ts"], "source": source, "where": where, "text": (tail + block).decode("latin-1")}
                left, tail = left - len(block), block[-SCAN_SHARED:]

    return parsed(streams, texts, schema, types, most_rows=1)


def surfaces(streams: DataFrame, http: DataFrame, dns: DataFrame, icmp: DataFrame, most: int | None = Limits.scan_window) -> DataFrame:
    """source, where, ts, text: what rules are tried on. Bytes are read as Latin-1; of a side of a stream and of an answer's body
    `most` bytes, None for all."""
    latin = lambda c: F.decode(c, "ISO-8859-1")
    follow = lambda c: F.concat(F.lit("; open with: wirelens stream "), F.col(c).cast("string"))
    from_streams = _side_texts(streams, most)
    part = lambda name, c: F.struct(F.concat(F.lit(f"HTTP {name}: "), F.col("host"), F.col("path")).alias("source"), F.concat(F.lit(f"HTTP {name}"), follow("stream")).alias("where"), c.alias("text"))
    from_http = http.select(
        "ts",
        F.explode(
            F.array(
                part("request line", F.concat_ws(" ", "method", "url", "version")), part("headers", F.concat_ws("\n", "user_agent", "auth_header", "cookies")), part("query string", F.col("query")),
                part("request body", latin("req_body")), part("response body", latin(F.col("resp_body") if most is None else F.substring("resp_body", 1, most))),
            )
        ).alias("s"),
    ).select("ts", "s.*")
    from_dns = dns.where("answer_type = 'TXT'").select("ts", F.concat(F.lit("DNS TXT of "), F.col("name")).alias("source"), F.lit("a DNS TXT value").alias("where"), F.explode("answers").alias("text"))
    from_icmp = icmp.select("ts", F.concat(F.lit("ICMP payload "), F.col("src"), F.lit("→"), F.col("dst")).alias("source"), F.lit("an ICMP payload").alias("where"), latin("payload").alias("text"))
    return from_streams.unionByName(from_http).unionByName(from_dns).unionByName(from_icmp).where("text <> ''")


def secrets(surfaces_df: DataFrame, rules: dict[str, Rule], extra: Rule | None = None) -> DataFrame:
    """The first hit of each kind and value: kind, value, confidence, rule, score, source, ts, how."""

    def found(some) -> DataFrame:
        hits = ruleops.distinct_hits(ruleops.scan(surfaces_df, some), ["ts", "source"])
        return hits.withColumn("how", F.concat(F.lit("regex '"), F.col("rule"), F.lit("' matched in "), F.col("where")))

    # attack patterns are the detector's
    base = found([r for r in rules.values() if not r.id.startswith("http.")])
    return ruleops.merge_hits(base, found([extra])) if extra else base.orderBy("kind", F.col("confidence") != "high", "value")
