"""Column functions over addresses, ports and domain names."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookups import DC_PORTS, EPHEMERAL_MIN, L7, OUI, SERVICES, TELEMETRY_DOMAINS, UDP_ONLY
from .text import labels

V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
# IPv4 blocks as patterns of the address text, and two addresses inside them that are public.
LOOPBACK, LINK_LOCAL, MULTICAST, RESERVED, SHARED = r"127\.", r"169\.254\.", r"(?:22[4-9]|23\d)\.", r"(?:24\d|25[0-5])\.", r"100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."
PRIVATE = (
    r"0\.", r"10\.", LOOPBACK, LINK_LOCAL, r"172\.(?:1[6-9]|2\d|3[01])\.", r"192\.0\.0\.", r"192\.0\.2\.", r"192\.168\.", r"198\.1[89]\.", r"198\.51\.100\.", r"203\.0\.113\.", RESERVED,
)
PUBLIC_INSIDE = ("192.0.0.9", "192.0.0.10")


def ip_to_long(ip: Column) -> Column:
    """IPv4 address as a number, null for anything else."""
    parts = F.split(ip, r"\.")
    value = sum((parts[k].try_cast("long") * 256 ** (3 - k) for k in range(1, 4)), parts[0].try_cast("long") * 256**3)
    return F.when(ip.rlike(V4), value)


def _in(ip: Column, *blocks: str) -> Column:
    return ip.rlike(f"^(?:{'|'.join(blocks)})")


@F.pandas_udf(T.StringType())
def _v6_class(ips: pd.Series) -> pd.Series:
    def one(ip: str) -> str:
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return "unknown"
        for name in ("loopback", "link_local", "multicast", "reserved", "private"):
            if getattr(a, f"is_{name}"):
                return name.replace("_", "-")
        return "public"

    return ips.map(one)


def classify_network(ip: Column, with_v6: bool = False) -> Column:
    """loopback, link-local, multicast, reserved, private, public or unknown. IPv6 needs Python: only with_v6."""
    v4 = (
        F.when(_in(ip, LOOPBACK), "loopback")
        .when(_in(ip, LINK_LOCAL), "link-local")
        .when(_in(ip, MULTICAST), "multicast")
        .when(_in(ip, RESERVED), "reserved")
        .when(_in(ip, *PRIVATE) & ~ip.isin(*PUBLIC_INSIDE), "private")
        .otherwise("public")
    )
    other = F.when(ip.contains(":"), _v6_class(ip)).otherwise("unknown") if with_v6 else F.lit("unknown")
    return F.when(ip.rlike(V4), v4).otherwise(other)


def is_internal(ip: Column, with_v6: bool = False) -> Column:
    """Whether the address is of a block that isn't routed on the internet; false for anything else."""
    v4 = F.coalesce(ip.rlike(V4) & _in(ip, *PRIVATE, SHARED) & ~ip.isin(*PUBLIC_INSIDE), F.lit(False))
    if not with_v6:
        return v4
    return F.when(ip.contains(":"), _v6_class(ip).isin("loopback", "link-local", "private")).otherwise(v4)


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def service_name(port: Column, proto: Column) -> Column:
    name = F.coalesce(_lookup(SERVICES, port), F.lit(""))
    return F.when((proto == "tcp") & port.isin(*UDP_ONLY), "").otherwise(name)


def vendor(mac: Column) -> Column:
    prefix = F.array_join(F.slice(F.split(F.regexp_replace(F.lower(mac), "-", ":"), ":"), 1, 3), ":")
    return F.coalesce(_lookup(OUI, prefix), F.lit(""))


def l7_protocol(proto: Column, sport: Column, dport: Column, payload_len: Column) -> Column:
    """Application protocol by destination port, else by source port; null without payload."""
    table = {f"{p}/{n}": name for (p, n), name in L7.items()}
    at = lambda port: _lookup(table, F.concat(proto, F.lit("/"), port.cast("string")))
    return F.when((payload_len > 0) & proto.isin("tcp", "udp"), F.coalesce(at(dport), at(sport)))


def is_telemetry_domain(name: Column) -> Column:
    bare = F.regexp_replace(F.lower(name), r"\.+$", "")
    alternatives = "|".join(d.replace(".", r"\.") for d in TELEMETRY_DOMAINS)
    return F.coalesce(bare.rlike(rf"^(?:.*\.)?(?:{alternatives})$"), F.lit(False))


def is_well_known_query(name: Column) -> Column:
    """Service discovery: an underscore label before the last, or a first label of proxy or NetBIOS lookups."""
    ls = labels(name)
    underscore = F.exists(F.slice(ls, F.lit(1), F.greatest(F.size(ls) - 1, F.lit(0))), lambda x: x.startswith("_"))
    first = F.lower(ls[0])
    return F.coalesce((name != "") & (underscore | first.rlike(r"^(?:wpad|isatap|nbt-)(?:[-].*)?$")), F.lit(False))


def is_dc_port(port: Column) -> Column:
    return port.isin(*DC_PORTS) | (port >= EPHEMERAL_MIN)


def canonical_pair(src: Column, sport: Column, dst: Column, dport: Column) -> tuple[Column, Column]:
    """The two endpoints, the smaller (by address text, then port) first."""
    a, b = F.struct(src.alias("ip"), sport.alias("port")), F.struct(dst.alias("ip"), dport.alias("port"))
    return F.least(a, b), F.greatest(a, b)
