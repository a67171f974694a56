"""Column functions over names, labels, values and byte strings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import MAGIC, TWO_PART_TLDS

PRINTABLE = r"[\x20-\x7e\t\n\r]"


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    # counts of equal characters: lengths of the runs after sorting
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    total = F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, total + 0.0).otherwise(F.lit(0.0))


def labels(name: Column) -> Column:
    return F.split(F.regexp_replace(name, r"\.+$", ""), r"\.")


def base_domain(name: Column) -> Column:
    """Last two labels, three under a two-label public suffix; shorter names are returned as they are."""
    ls, bare = labels(name), F.regexp_replace(name, r"\.+$", "")
    last2 = F.array_join(F.slice(ls, -2, 2), ".")
    return (
        F.when(F.size(ls) <= 2, bare).when(last2.isin(*TWO_PART_TLDS), F.array_join(F.slice(ls, F.greatest(F.size(ls) - 2, F.lit(1)), F.lit(3)), ".")).otherwise(last2)
    )


def subdomain(name: Column) -> Column:
    """All labels but the last; `(root)` if there are none."""
    ls = labels(name)
    rest = F.array_join(F.slice(ls, F.lit(1), F.greatest(F.size(ls) - 1, F.lit(0))), ".")
    return F.when(rest == "", "(root)").otherwise(rest)


def length_class(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 10, "1-9").when(n < 100, "10-99").when(n < 1000, "100-999").otherwise("1000+")


def ttl_class(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 64, "1-63").when(n < 128, "64-127").when(n < 256, "128-255").otherwise("256+")


def looks_like_base64(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9+/=]+$") & (F.length(s) % 4 == 0) & (F.length(F.regexp_replace(s, "=+$", "")) >= 8)


def looks_like_base32(s: Column) -> Column:
    return s.rlike("^[A-Z2-7=]+$") & (F.length(s) % 8 == 0) & (F.length(F.regexp_replace(s, "=+$", "")) >= 8)


def looks_like_hex(s: Column) -> Column:
    return s.rlike("^[0-9a-fA-F]{8,}$") & (F.length(s) % 2 == 0)


def looks_like_url_encoded(s: Column) -> Column:
    return F.regexp_count(s, F.lit("%[0-9A-Fa-f]{2}")) >= 2


def printable_ratio(s: Column) -> Column:
    """Share of printable ASCII; 0 for an empty string."""
    n = F.length(s)
    return F.when(n > 0, F.regexp_count(s, F.lit(PRINTABLE)) / n).otherwise(0.0)


def rot13(s: Column) -> Column:
    abc = "abcdefghijklmnopqrstuvwxyz"
    src, dst = abc + abc.upper(), abc[13:] + abc[:13] + abc[13:].upper() + abc[:13].upper()
    return F.translate(s, src, dst)


def url_path(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_query(url: Column) -> Column:
    return F.when(F.instr(url, "?") > 0, F.regexp_extract(url, r"^[^?]*\?([\s\S]*)$", 1)).otherwise("")


def mask_password(p: Column) -> Column:
    """Up to two characters all stars, else the first and last with the length."""
    n = F.length(p)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(p, 1, 1), F.lit("…"), F.substring(p, -1, 1), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


def mask_secret(v: Column) -> Column:
    """Up to twelve characters plain, else the first eight and last four."""
    return F.when(F.length(v) <= 12, v).otherwise(F.concat(F.substring(v, 1, 8), F.lit("…"), F.substring(v, -4, 4)))


def format_bytes(n: Column) -> Column:
    """1024 steps; whole bytes, else one decimal."""
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1)))
    return out.otherwise(F.format_string("%.1f TiB", F.bround(n / float(1024**4), 1)))


def utc_time(seconds: Column) -> Column:
    """Epoch seconds as `YYYY-MM-DD HH:MM:SS.mmm+00:00` (the session's time zone must be UTC)."""
    return F.concat(F.date_format(F.timestamp_millis(F.floor(seconds * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00:00"))


def detect_type(data: Column) -> Column:
    """Type of a byte string by its magic, else text or binary data by the first 512 bytes."""
    text = F.decode(F.substring(data, 1, 512), "ISO-8859-1")
    out = None
    for magic, offset, name in MAGIC:
        hit = F.hex(F.substring(data, offset + 1, len(magic))) == magic.hex().upper()
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when((F.length(text) > 0) & (F.regexp_count(text, F.lit(PRINTABLE)) / F.length(text) > 0.9), "text").otherwise("binary data")


def sanitize_filename(name: Column, fallback: str = "unnamed") -> Column:
    """Base name with safe characters only; any other character is an underscore."""
    base = F.substring_index(F.regexp_replace(name, r"\\", "/"), "/", -1)
    safe = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._\- ]", "_"), r"^[. ]+|[. ]+$", "")
    safe = F.substring(F.regexp_replace(safe, r"\s+", "_"), 1, 100)
    return F.when(safe == "", fallback).otherwise(safe)
