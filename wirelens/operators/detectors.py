"""Detectors: the statistics they rest on, and the findings made of them.

A detector takes the Analysis and gives findings. Each is lazy; what it reads of the analysis is all that is planned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions import net, text
from ..functions.lookups import ABUSED_PORTS, LDAP_PORTS
from . import app, dns, intervals
from .findings import capped, finding, mitre_column
from .flows import per_capture
from .rules import scan


def syn_scan_stats(flows: DataFrame, least: int = 10) -> DataFrame:
    """By source: SYN flows, those never answered and their ports, where enough and at least 30 % are unanswered."""
    syn = flows.where("proto = 'tcp' AND syn_count > 0")
    open_ = ~F.col("ack_of_syn")
    out = syn.groupBy("src").agg(
        F.count(F.lit(1)).alias("syn_flows"), F.count_if(open_).alias("attempted"), F.count_distinct(F.when(open_, F.col("dport"))).alias("ports"),
        F.slice(F.sort_array(F.collect_set(F.when(open_, F.col("dport")))), 1, 12).alias("examples"), F.count_if("ack_of_syn").alias("completed"),
        F.min(F.when(open_, F.col("first_ts"))).alias("first_ts"), F.max(F.when(open_, F.col("last_ts"))).alias("last_ts"), F.min("first_frame").alias("first_frame"),
    )
    return out.where((F.col("attempted") >= least) & (10 * F.col("attempted") >= 3 * F.col("syn_flows")))


def host_sweep_stats(flows: DataFrame) -> DataFrame:
    """By source and port: distinct destinations of SYN flows."""
    return flows.where("proto = 'tcp' AND syn_count > 0").groupBy("src", "dport").agg(
        F.count_distinct("dst").alias("targets"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def ldap_listeners(flows: DataFrame) -> DataFrame:
    """Internal addresses that answer or receive data on an LDAP port."""
    serving = (F.col("proto") == "tcp") & F.col("dport").isin(*LDAP_PORTS) & (F.col("ack_of_syn") | (F.col("bytes") > 0)) & net.is_internal(F.col("dst"))
    return flows.where(serving).select(F.col("dst").alias("dc")).distinct()


def without_dc_traffic(flows: DataFrame, dcs: DataFrame) -> DataFrame:
    """flows less those to a domain controller's service ports."""
    return flows.join(dcs, (F.col("dst") == F.col("dc")) & net.is_dc_port(F.col("dport")), "left_anti")


def srv_controllers(records: DataFrame) -> DataFrame:
    """Addresses of the targets of LDAP service records of a domain's controllers."""
    answers = records.where("is_response").select(F.lower(F.regexp_replace("name", r"\.+$", "")).alias("bare"), "name", F.explode("answers").alias("answer"))
    tokens = F.filter(F.split("answer", " "), lambda t: t.contains(".") & ~t.rlike("^[0-9]"))
    srv = answers.where(F.col("name").contains("._msdcs.") & F.col("name").startswith("_ldap._tcp"))
    targets = srv.select(F.lower(F.regexp_replace(F.get(F.reverse(tokens), F.lit(0)), r"\.+$", "")).alias("target")).where("target IS NOT NULL").distinct()
    return answers.join(targets, F.col("bare") == F.col("target"), "left_semi").where(F.col("answer").rlike(net.V4)).select(F.col("answer").alias("dc")).distinct()


def domain_controllers(flows: DataFrame, records: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """LDAP listeners, targets of service records, and those named by the user; of the first two only internal ones."""
    found = ldap_listeners(flows).union(srv_controllers(records).where(net.is_internal(F.col("dc"))))
    return (found.union(extra) if extra is not None else found).distinct()


def _text(template: str, *cols) -> Column:
    return F.format_string(template, *[F.col(c) if isinstance(c, str) else c for c in cols])


def detect_syn_scan(a) -> DataFrame:
    d = capped(syn_scan_stats(a.flows), 10, "first_frame")
    return finding(
        d, id=_text("scan.syn.%s", "src"), title=_text("Port scan by %s: %d attempts", "src", "attempted"), severity="HIGH", confidence=F.when(F.col("attempted") >= 30, "high").otherwise("medium"),
        description=_text("%s opened connections to %d ports that nobody completed; %d handshakes of its were completed.", "src", "ports", "completed"),
        explanation="Trying many ports without finishing a handshake is how open services are looked for. Monitoring does it too: find out what the host is.",
        verification=_text("ip.src == %s && tcp.flags.syn == 1 && !tcp.flags.ack, then see which ports answered.", "src"),
        evidence=[_text("ports tried: %d", "ports"), F.concat(F.lit("among them: "), F.array_join(F.col("examples").cast("array<string>"), ", ")), _text("window: %.1f s", F.col("last_ts") - F.col("first_ts"))],
        hosts=F.array("src"), protocol="tcp", first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), filters=[_text("ip.src == %s && tcp.flags.syn == 1 && !tcp.flags.ack", "src")],
        mitre=[("T1046", "many ports were tried"), ("T1595", "hosts were probed actively")],
    )


def detect_host_scan(a) -> DataFrame:
    d = capped(host_sweep_stats(a.flows).where("targets >= 20"), 5, F.col("targets").desc(), "src", "dport")
    return finding(
        d, id=_text("scan.host.%s.%d", "src", "dport"), title=_text("Host sweep by %s: %d hosts on port %d", "src", "targets", "dport"), severity="MEDIUM", confidence="medium",
        description=_text("%s tried %d hosts on port %d.", "src", "targets", "dport"), explanation="One port on many hosts is how a vulnerable service is looked for, and how inventories are made.",
        verification=_text("ip.src == %s && tcp.dstport == %d, then count the destinations.", "src", "dport"), evidence=[_text("destinations: %d", "targets")], hosts=F.array("src"), protocol="tcp",
        first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), filters=[_text("ip.src == %s && tcp.dstport == %d", "src", "dport")], mitre=[("T1595.001", "many addresses were tried on one port")],
    )


def detect_unusual_ports(a) -> DataFrame:
    why = F.create_map(*[F.lit(x) for kv in ABUSED_PORTS.items() for x in kv])[F.col("service_port")]
    d = capped(a.conversations.where((F.col("proto") == "tcp") & (F.col("bytes") > 0) & why.isNotNull()).withColumn("why", why), 10, "first_frame")
    return finding(
        d, id=_text("port.unusual.%s.%s.%d", "a", "b", "service_port"), title=_text("Data on port %d (%s)", "service_port", "why"), severity="MEDIUM", confidence="low",
        description=_text("%s and %s exchanged data on port %d, a default of %s.", "a", "b", "service_port", "why"), explanation="The port alone is weak evidence: read the stream before deciding.",
        verification=_text("tcp.port == %d, then follow the stream.", "service_port"), evidence=[_text("%d bytes", "bytes")], hosts=F.array("a", "b"), protocol="tcp", first_ts=F.col("first_ts"), last_ts=F.col("last_ts"),
        filters=[_text("tcp.port == %d", "service_port")], mitre=[("T1571", "a port that tools use by default")],
    )


def detect_tcp_beaconing(a) -> DataFrame:
    starts = without_dc_traffic(a.flows.where("proto = 'tcp'"), a.domain_controllers)
    stats = intervals.beacon_verdict(intervals.interval_stats(starts.withColumnRenamed("first_ts", "ts"), per_capture(starts, "src", "dst", "dport"), size="bytes"))
    d = capped(stats.where("severity IS NOT NULL"), 6, "src", "dst", "dport")
    technique = F.when(F.col("dport").isin(80, 8080, 443, 8443), "T1071.001").otherwise("T1095")
    return finding(
        d, id=_text("beacon.tcp.%s.%s.%d", "src", "dst", "dport"), title=_text("Timed connections from %s to %s:%d: %d, %.1f s apart", "src", "dst", "dport", "events", "mean_interval"), severity=F.col("severity"),
        confidence=F.col("confidence"), description=_text("%d connections, %.1f s apart on average, coefficient of variation %.2f.", "events", "mean_interval", "cv"),
        explanation="Timers make even intervals. Implants have them, and so have updaters, clocks and monitors: look at the destination and the content.",
        verification=_text("ip.addr == %s && tcp.port == %d, then look at the times between connections.", "dst", "dport"), evidence=[_text("jitter %.2f s", "jitter"), _text("size variation %.2f over %d connections with data", "size_cv", "sized")],
        hosts=F.array("src", "dst"), protocol="tcp", first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), filters=[_text("ip.addr == %s && tcp.port == %d", "dst", "dport")], mitre=[(mitre_column(technique, "connections as by a timer"), "")],
    )


def detect_dns_beaconing(a) -> DataFrame:
    asked = a.dns_named.where(~F.col("is_response") & ~F.col("well_known") & ~net.is_telemetry_domain(F.col("name")))
    stats = intervals.interval_stats(asked, per_capture(asked, "client", "name"))
    d = capped(stats.where(f"events >= {intervals.MIN_EVENTS} AND intervals >= {intervals.MIN_INTERVALS} AND cv < {intervals.CV_MEDIUM}"), 4, "client", "name")
    return finding(
        d, id=_text("beacon.dns.%s.%s", "client", "name"), title=_text("Timed lookups of %s by %s: %d, %.1f s apart", "name", "client", "events", "mean_interval"), severity="MEDIUM",
        confidence=F.when(F.col("cv") < intervals.CV_HIGH, "medium").otherwise("low"), description=_text("%d lookups, coefficient of variation %.2f.", "events", "cv"), explanation="A name that is looked up by a timer is kept in use by a program.",
        verification=_text('dns.qry.name == "%s" && ip.src == %s', "name", "client"), hosts=F.array("client"), protocol="dns", first_ts=F.col("first_ts"), last_ts=F.col("last_ts"),
        filters=[_text('dns.qry.name == "%s"', "name")], mitre=[("T1071.004", "lookups as by a timer")],
    )


def detect_dns_tunneling(a) -> DataFrame:
    d = capped(dns.tunnel_signals(a.dns_named).where("signals > 0"), 8, "first_frame")
    n = F.col("signals")
    return finding(
        d, id=_text("dns.tunnel.%s", "domain"), title=_text("Data in DNS names under %s", "domain"), severity=F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW"),
        confidence=F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low"), description=_text("%d lookups show %d signals of encoded data.", "queries", "signals"),
        explanation="Data in names makes labels long, random and always new. Content networks make many names too: see whether the labels decode.", verification=_text('dns.qry.name contains "%s"', "domain"),
        evidence=[_text("longest label %d", "longest_label"), _text("most entropy %.3f bits a character", "max_entropy"), _text("names under the domain: %d", "subdomains"), _text("TXT answers: %d", "txt"), F.concat(F.lit("first names: "), F.array_join("examples", ", "))],
        hosts=F.col("hosts"), protocol="dns", first_ts=F.col("first_ts"), filters=[_text('dns.qry.name contains "%s"', "domain")], mitre=[("T1071.004", "DNS as a data channel"), ("T1132.001", "labels look encoded")],
    )


def detect_nxdomain_anomaly(a) -> DataFrame:
    d = capped(dns.nxdomain_rates(a.dns_named).where("anomaly"), 4, "first_frame")
    return finding(
        d, id=_text("dns.nx.%s", "domain"), title=_text("Names under %s that don't exist: %d of %d", "domain", "active_nx", "active"), severity="LOW", confidence="low", description=_text("%d of %d lookups failed.", "active_nx", "active"),
        explanation="Failing lookups come from generated names, from guessing of names, or from broken software.", verification=_text('dns.qry.name contains "%s" && dns.flags.rcode == 3', "domain"), hosts=F.col("hosts"), protocol="dns",
        filters=[_text('dns.qry.name contains "%s" && dns.flags.rcode == 3', "domain")], mitre=[("T1071.004", "failing lookups in number")],
    )


def detect_suspicious_txt(a) -> DataFrame:
    d = capped(dns.suspicious_txt(a.dns_named), 1, "frame")
    return finding(
        d, id=_text("dns.txt.%s", "domain"), title=_text("Dense TXT record of %s", "domain"), severity="MEDIUM", confidence="medium", description=_text("A TXT value of %d characters looks encoded.", F.length("value")),
        explanation="Policies in TXT records can be read; answers of a tunnel can't.", verification=_text('dns.qry.name contains "%s" && dns.txt', "domain"), evidence=[F.substring("value", 1, 80)], hosts=F.array("client"), protocol="dns",
        filters=[_text('dns.qry.name contains "%s" && dns.txt', "domain")], mitre=[("T1071.004", "data in TXT records")],
    )


#: Rule kinds that make an attack pattern severe.
SEVERE_KINDS = ("webshell", "command-injection", "sql-injection")


def detect_http_attacks(a) -> DataFrame:
    latin = lambda c: F.decode(c, "ISO-8859-1")
    t = a.http.select(
        "client", "host", "stream", "ts", "n",
        F.explode(F.array(F.concat_ws(" ", "method", "url"), F.col("user_agent"), latin("req_body"), latin(F.substring("resp_body", 1, 65536)))).alias("text"),
    )
    hits = scan(t, [r for r in a.rules.values() if r.id.startswith("http.")])
    by = hits.groupBy("rule", "kind", "confidence").agg(
        F.count(F.lit(1)).alias("hits"), F.sort_array(F.collect_set("client")).alias("clients"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("value", F.struct("ts", "stream", "n", "value")).alias("example"), F.min("stream").alias("stream"),
    )
    return finding(
        capped(by, 12, "first_ts", "rule"), id=F.concat(F.lit("http."), F.col("rule")), title=_text("HTTP attack pattern: %s (%d)", "kind", "hits"), severity=F.when(F.col("kind").isin(*SEVERE_KINDS), "HIGH").otherwise("MEDIUM"), confidence=F.when(F.col("confidence") == "high", "high").otherwise("medium"),
        description=_text("The pattern %s occurs %d times in requests or answers.", "rule", "hits"), explanation="A pattern shows an attempt, or a page about one; what the server answered shows whether it worked.",
        verification=_text("tcp.stream == %d, then read request and answer.", "stream"), evidence=[F.substring("example", 1, 160)], hosts=F.col("clients"), protocol="http", first_ts=F.col("first_ts"), last_ts=F.col("last_ts"),
        filters=[_text("tcp.stream == %d", "stream")], mitre=[(mitre_column(F.when(F.col("kind") == "webshell", "T1505.003").when(F.col("kind") == "traversal", "T1083").otherwise("T1190"), "a pattern of attack in HTTP"), "")],
    )


def _one(df: DataFrame, *aggs: Column) -> DataFrame:
    """One row about all rows of df, none if it has none."""
    return df.agg(F.count(F.lit(1)).alias("n"), *aggs).where("n > 0")


def detect_cleartext_auth(a) -> DataFrame:
    d = _one(a.credentials.where("kind = 'auth-header'"), F.sort_array(F.collect_set("client")).alias("clients"), F.min("ts").alias("first_ts"), F.min("stream").alias("stream"))
    return finding(
        d, id="http.basic-auth-cleartext", title=_text("Credentials in HTTP headers (%d)", "n"), severity="MEDIUM", confidence="high", description=_text("%d requests carry a user and password that anybody can read.", "n"),
        explanation="Basic authentication is an encoding, no encryption.", verification="http.authorization", hosts=F.col("clients"), protocol="http", first_ts=F.col("first_ts"), filters=["http.authorization"], mitre=[("T1552.001", "credentials in clear text")],
    )


def detect_unusual_methods(a) -> DataFrame:
    odd = a.http.where(F.col("method").isin("TRACE", "CONNECT", "TRACK", "PUT", "DELETE", "PATCH"))
    d = _one(odd, F.sort_array(F.collect_set("method")).alias("methods"), F.sort_array(F.collect_set("client")).alias("clients"), F.min("ts").alias("first_ts"))
    return finding(
        d, id="http.unusual-methods", title=F.concat(F.lit("Unusual HTTP methods: "), F.array_join("methods", ", ")), severity="LOW", confidence="medium", description=_text("%d requests use methods that change or probe a server.", "n"),
        explanation="Interfaces for programs use them every day; on a web site they are rare.", verification='http.request.method in {"TRACE", "CONNECT", "TRACK", "PUT", "DELETE", "PATCH"}', hosts=F.col("clients"), protocol="http", first_ts=F.col("first_ts"),
        mitre=[("T1190", "methods that probe a server")],
    )


def detect_arp_conflict(a) -> DataFrame:
    d = capped(app.arp_conflicts(a.arp), 6, "first_ts", "sender_ip")
    return finding(
        d, id=_text("arp.conflict.%s", "sender_ip"), title=_text("Two devices claim %s", "sender_ip"), severity="HIGH", confidence="medium", description=F.concat(F.lit("Claimed by "), F.array_join("macs", ", "), F.lit(".")),
        explanation="A second claimant reads the first one's traffic, or took over from it after a failure.", verification=_text("arp.src.proto_ipv4 == %s", "sender_ip"), evidence=[F.array_join("macs", ", ")], hosts=F.array("sender_ip"), protocol="arp",
        first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), filters=[_text("arp.src.proto_ipv4 == %s", "sender_ip")], mitre=[("T1557", "conflicting claims of an address")],
    )


def detect_icmp_payload(a) -> DataFrame:
    d = _one(a.icmp.where("icmp_type = 'echo-request' AND payload_len >= 16"), F.sum("payload_len").alias("bytes"), F.sort_array(F.array_union(F.collect_set("src"), F.collect_set("dst"))).alias("hosts"), F.min("ts").alias("first_ts"), F.min_by("payload", "frame").alias("example"))
    return finding(
        d, id="icmp.payload-channel", title=_text("Pings that carry data: %d bytes", "bytes"), severity="MEDIUM", confidence="low", description=_text("%d echo requests carry 16 bytes or more.", "n"),
        explanation="Pings need no content. Some monitors put a pattern there; a channel puts its data there.", verification="icmp.type == 8 && data.len >= 16", evidence=[F.decode(F.substring("example", 1, 64), "ISO-8859-1")], hosts=F.col("hosts"),
        protocol="icmp", first_ts=F.col("first_ts"), filters=["icmp.type == 8 && data.len >= 16"], mitre=[("T1095", "ping as a channel"), ("T1048.003", "data outside of application protocols")],
    )


def detect_cleartext_protocols(a) -> DataFrame:
    c = a.credentials.where("kind IN ('login', 'auth')")
    d = c.groupBy("protocol").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("client", "server", "stream", "username", text.mask_password(F.col("password")).alias("pw")), F.struct("ts", "stream", "pos")).alias("c"), F.min("ts").alias("first_ts"))
    return finding(
        d, id=_text("creds.cleartext.%s", "protocol"), title=_text("%s passwords in clear text (%d)", F.upper("protocol"), "n"), severity="HIGH", confidence="high", description=_text("%s logged in to %s without encryption.", "c.client", "c.server"),
        explanation="Whoever has this capture has these passwords. Change them, and use the protocol's encrypted form.", verification=_text("tcp.stream == %d, then follow the stream.", "c.stream"), evidence=[_text("user %s, password %s", "c.username", "c.pw")],
        hosts=F.array("c.client", "c.server"), protocol=F.col("protocol"), first_ts=F.col("first_ts"), filters=[_text("tcp.stream == %d", "c.stream")], mitre=[("T1552.001", "credentials in clear text")],
    )


def detect_secret_material(a) -> DataFrame:
    def of(kind: str, id_: str, title: str, severity: str, confidence: str, technique: str) -> DataFrame:
        d = _one(a.secrets.where(F.col("kind") == kind), F.array(F.min("source")).alias("sources"), F.min(text.mask_secret(F.col("value"))).alias("example"))
        return finding(
            d, id=id_, title=_text(title + " (%d)", "n"), severity=severity, confidence=confidence, description=_text("%d values were sent in clear text.", "n"), explanation="Replace them, and find out who sent them. Examples look the same: never try a key to find out.",
            verification="frame contains the value", evidence=[F.get("sources", F.lit(0)), F.col("example")], protocol="", mitre=[(technique, "secrets in traffic")],
        )

    return of("key-material", "secrets.private-key", "Private keys in traffic", "CRITICAL", "high", "T1552.004").unionByName(of("api-key", "secrets.api-keys", "Keys of services in traffic", "HIGH", "medium", "T1552.001"))


BULK_BYTES = 50 << 20


def detect_bulk_transfer(a) -> DataFrame:
    d = capped(a.conversations.where((F.col("bytes") >= BULK_BYTES) & net.is_internal(F.col("a")) & ~net.is_internal(F.col("b"))), 5, "first_frame")
    return finding(
        d, id=_text("exfil.bulk.%s.%s.%d", "a", "b", "service_port"), title=_text("Bulk transfer from %s to %s: %.1f MB", "a", "b", F.col("bytes") / 1e6), severity="MEDIUM", confidence="low", description=_text("One %s conversation moved %d bytes out.", "proto", "bytes"),
        explanation="A matter of volume alone: backups and uploads look alike.", verification=_text("ip.addr == %s && tcp.port == %d", "b", "service_port"), evidence=[_text("%d packets", "packets")], hosts=F.array("a", "b"), protocol=F.col("proto"),
        first_ts=F.col("first_ts"), last_ts=F.col("last_ts"), filters=[_text("ip.addr == %s && tcp.port == %d", "b", "service_port")], mitre=[("T1048.003", "much data to the outside")],
    )


def detect_covert(a) -> DataFrame:
    c = F.col("confidence")
    d = capped(a.covert, 6, F.col("printable").desc(), "protocol", "field", "source")
    return finding(
        d, id=F.concat_ws(".", F.lit("covert"), "protocol", "field", "source"), title=_text("%s: the %s of %s spells text", "protocol", "field", "source"), severity=F.when(c == "high", "HIGH").when(c == "medium", "MEDIUM").otherwise("LOW"),
        confidence=c, description=_text("%d values decode to %d bytes, %.0f %% printable.", "length", "byte_len", F.col("printable") * 100), explanation="Fields that a sender may choose can carry bits. The reading shown is the best of those tried.",
        verification="Read the field's values in order and map them as given.", evidence=[F.concat(F.lit("decoded: "), F.substring("decoded", 1, 120)), F.col("pattern")], hosts=F.array("source"), protocol=F.col("protocol"), first_ts=F.col("first_ts"), last_ts=F.col("last_ts"),
        mitre=[("T1132.001", "a field used as a code")],
    )


DETECTORS: dict[str, Callable] = {
    f.__name__.removeprefix("detect_"): f
    for f in (
        detect_syn_scan, detect_host_scan, detect_unusual_ports, detect_tcp_beaconing, detect_dns_beaconing, detect_dns_tunneling, detect_nxdomain_anomaly, detect_suspicious_txt, detect_http_attacks,
        detect_cleartext_auth, detect_unusual_methods, detect_arp_conflict, detect_icmp_payload, detect_cleartext_protocols, detect_secret_material, detect_bulk_transfer, detect_covert,
    )
}


def register_detector(name: str, detector: Callable) -> None:
    """Add a detector: a function of the Analysis that gives findings."""
    DETECTORS[name] = detector
