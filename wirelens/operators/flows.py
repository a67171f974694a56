"""Hosts, flows and conversations of packets.

Every aggregate is map-side combined. Flows are keyed by capture and directed 5-tuple, conversations by capture and the
unordered pair of endpoints; `frame` breaks ties of first and last. Hosts and counts are over all captures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

FLOW_KEY = ("proto", "src", "sport", "dst", "dport")


def per_capture(df: DataFrame, *key: str) -> list[str]:
    """key, within each capture file where rows come from several: their frames count from 1 in each."""
    return ["file", *key] if "file" in df.columns else list(key)


def _carried(packets: DataFrame) -> DataFrame:
    return packets.where("proto IN ('tcp', 'udp') AND src <> '' AND dst <> ''")


def flows(packets: DataFrame) -> DataFrame:
    """One row per directed 5-tuple, with whether its SYN was answered.

    A SYN+ACK answers the reversed flow if that flow had begun: a semi-join on the swapped key and the first frame.
    """
    s, a = F.col("tcp_flags").contains("S"), F.col("tcp_flags").contains("A")
    key = per_capture(packets, *FLOW_KEY)
    agg = _carried(packets).groupBy(*key).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("payload_len").cast("long")).alias("bytes"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min("frame").alias("first_frame"),
        F.count_if(s & ~a).alias("syn_count"),
        F.count_if(F.col("tcp_flags").contains("F")).alias("fin_count"),
        F.count_if(F.col("tcp_flags").contains("R")).alias("rst_count"),
        F.max(F.when(s & a & (F.col("proto") == "tcp"), F.col("frame"))).alias("last_synack"),
    )
    answers = agg.where("last_synack IS NOT NULL").select(
        *[F.col(k).alias(f"r_{k}") for k in key if k == "file"], F.col("proto").alias("r_proto"), F.col("dst").alias("r_src"), F.col("dport").alias("r_sport"), F.col("src").alias("r_dst"), F.col("sport").alias("r_dport"), F.col("last_synack").alias("r_frame")
    )
    on = [F.col(k) == F.col(f"r_{k}") for k in key]
    joined = agg.drop("last_synack").join(answers, on, "left")
    answered = F.coalesce((F.col("proto") == "tcp") & (F.col("r_frame") >= F.col("first_frame")), F.lit(False))
    return joined.withColumn("ack_of_syn", answered).drop(*[f"r_{k}" for k in key], "r_frame")


def conversations(packets: DataFrame) -> DataFrame:
    """One row per unordered pair of endpoints; a is the source of the first packet, service_port b's port."""
    low, high = net.canonical_pair(F.col("src"), F.col("sport"), F.col("dst"), F.col("dport"))
    first = F.min(F.struct("frame", "src", "sport", "dst", "dport")).alias("first")
    file = per_capture(packets)
    agg = _carried(packets).groupBy(*file, "proto", low.alias("low"), high.alias("high")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.col("payload_len").cast("long")).alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), first
    )
    return agg.select(
        *file, "proto", F.col("first.src").alias("a"), F.col("first.sport").alias("a_port"), F.col("first.dst").alias("b"), F.col("first.dport").alias("b_port"),
        F.col("first.dport").alias("service_port"), "packets", "bytes", "first_ts", "last_ts", F.col("first.frame").alias("first_frame"),
    )


def hosts(packets: DataFrame, with_v6: bool = False, address: Callable[[Column], Column] = lambda ip: ip) -> DataFrame:
    """One row per address in either role. services: ports that private sources contacted on it. address: gives the address that
    a name in src and dst stands for, where these are names."""
    both = (F.col("src") != "") & (F.col("dst") != "")
    port = F.when(both & (F.col("dport") != 0), F.col("dport"))
    sender = F.struct(
        F.col("src").alias("ip"), F.col("mac_src").alias("mac"), both.cast("long").alias("sent"), F.lit(0).cast("long").alias("received"),
        port.alias("contacted"), F.lit(None).cast("int").alias("service"),
    )
    receiver = F.struct(
        F.col("dst").alias("ip"), F.col("mac_dst").alias("mac"), F.lit(0).cast("long").alias("sent"), both.cast("long").alias("received"),
        F.lit(None).cast("int").alias("contacted"), F.when(net.classify_network(F.col("sender"), with_v6) == "private", port).alias("service"),
    )
    packets = packets.select("frame", "frame_len", "src", "dst", "mac_src", "mac_dst", "dport", address(F.col("src")).alias("sender"))
    roles = packets.select("frame", F.col("frame_len").cast("long").alias("len"), F.explode(F.array(sender, receiver)).alias("r")).select("frame", "len", "r.*").where("ip <> ''")
    found = roles.groupBy("ip").agg(
        F.sum("sent").alias("packets_sent"),
        F.sum("received").alias("packets_received"),
        F.sum(F.col("sent") * F.col("len")).alias("bytes_sent"),
        F.sum(F.col("received") * F.col("len")).alias("bytes_received"),
        F.sort_array(F.collect_set(F.when(F.col("mac") != "", F.col("mac")))).alias("macs"),
        F.sort_array(F.collect_set("contacted")).alias("ports_contacted"),
        F.sort_array(F.collect_set("service")).alias("services"),
        F.min("frame").alias("first_frame"),
    )
    return found.withColumn("as_address", address(F.col("ip"))).withColumn("is_internal", net.is_internal(F.col("as_address"), with_v6)).drop("as_address")


def learn_hostnames(hosts_df: DataFrame, dns: DataFrame) -> DataFrame:
    """hosts with the names whose answers hold the address."""
    answers = dns.where("is_response").select(F.explode("answers").alias("answer"), "name").where("name <> ''")
    names = answers.groupBy("answer").agg(F.sort_array(F.collect_set("name")).alias("hostnames"))
    joined = hosts_df.join(names, F.col("ip") == F.col("answer"), "left").drop("answer")
    return joined.withColumn("hostnames", F.coalesce("hostnames", F.array().cast("array<string>")))


def top_talkers(hosts_df: DataFrame, n: int = 10) -> DataFrame:
    return hosts_df.orderBy((F.col("bytes_sent") + F.col("bytes_received")).desc(), "first_frame", "ip").limit(n)


def top_conversations(convs: DataFrame, n: int = 10) -> DataFrame:
    return convs.orderBy(F.col("bytes").desc(), "first_frame").limit(n)


def protocol_counts(packets: DataFrame) -> DataFrame:
    proto = F.when(F.coalesce(F.col("proto"), F.lit("")) == "", "other").otherwise(F.col("proto"))
    return packets.groupBy(proto.alias("proto")).agg(F.count(F.lit(1)).alias("packets"))


def l7_counts(packets: DataFrame) -> DataFrame:
    name = net.l7_protocol(F.col("proto"), F.col("sport"), F.col("dport"), F.col("payload_len"))
    return packets.select(name.alias("l7")).where("l7 IS NOT NULL").groupBy("l7").agg(F.count(F.lit(1)).alias("packets"))


def totals(packets: DataFrame) -> DataFrame:
    return packets.agg(
        F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(F.col("frame_len").cast("long")), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.col("payload_len").cast("long")), F.lit(0)).alias("payload_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def mac_vendors(packets: DataFrame) -> DataFrame:
    return packets.where("mac_src <> ''").select("mac_src").distinct().withColumn("vendor", net.vendor(F.col("mac_src"))).where("vendor <> ''")


def protocol_rollup(packets: DataFrame) -> DataFrame:
    """Packets and bytes by transport and application protocol, with subtotals (null)."""
    l7 = F.coalesce(net.l7_protocol(F.col("proto"), F.col("sport"), F.col("dport"), F.col("payload_len")), F.lit("-"))
    return packets.withColumn("l7", l7).rollup("proto", "l7").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("frame_len").cast("long")).alias("bytes"))
