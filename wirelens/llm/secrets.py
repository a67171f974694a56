"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass of an Aho-Corasick automaton over the ASCII-lowered text finds every keyword. Only there is the kind's
pattern tried, anchored at the keyword. Kinds whose tokens carry a check value (CRC-32 in base 62, a decodable
header) are kept only if it holds; the public formats of slack, google and pem have none, so their form decides. Runs of hexadecimal digits have no keyword and are found by their own pattern.
A projection: no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_batches, sliced, text_or_empty

BASE_KINDS = ("assign", "access", "hex")
# The patterns of the contract, then public token formats.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(r"(?:eyJ)?[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
SLACK = re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")
GOOGLE = re.compile(r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(body: str) -> str:
    """CRC-32 of body as six base-62 digits, which such tokens end in."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, k = divmod(value, 62)
        digits = BASE62[k] + digits
    return digits


def _crc_holds(m: re.Match) -> bool:
    body = m[0].partition("_")[2]
    return crc_base62(body[:-6]) == body[-6:]


def _jwt_holds(m: re.Match) -> bool:
    head = m[0].partition(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


#: kind -> keywords (lower case), pattern, check
KINDS = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 20),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, _crc_holds),
    "npm": (("npm_",), NPM, _crc_holds),
    "jwt": (("eyj",), JWT, _jwt_holds),
    "pem": (("-----begin ",), PEM, lambda m: True),
    "slack": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), SLACK, lambda m: True),
    "google": (("aiza",), GOOGLE, lambda m: True),
}
ORDER = {k: n for n, k in enumerate(["assign", "access", "hex", *[k for k in KINDS if k not in BASE_KINDS]])}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (words, _, _) in KINDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and kind. Per kind leftmost and not overlapping. A match of a base kind that
    its check drops still hides what lies inside it; of an added kind it hides its first segment, up to a dot."""
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _automaton().iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for kind, starts in hits.items():
        _, pattern, holds = KINDS[kind]
        free = 0
        for start in sorted(starts):
            if start < free:
                continue
            if m := pattern.match(text, start):
                free = m.end()
                if holds(m):
                    found.append((start, free, kind))
                elif kind not in BASE_KINDS:
                    free = start + len(m[0].partition(".")[0])
            elif kind == "jwt":
                free = JWT_RUN.match(text, start).end()  # what follows the run decides for every start in it
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]]))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts of the base kinds, their digest, and all spans.

    Null text counts as empty: no spans, the digest of the empty string. Texts of any length are scanned whole, in
    linear time. Repeated rows each get their row, an empty table gives none; spans of different kinds may overlap, and those
    that start together are in the order of kinds. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for x in batch.column("text"):
                spans = find_spans(x.as_py())
                base = [s for s in spans if s[2] in BASE_KINDS]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*(sum(s[2] == k for s in base) for k in BASE_KINDS), digest, _joined(spans)))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, SCHEMA)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
