"""Joins by time: the last fact before a row, and rows inside windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(rows: DataFrame, facts: DataFrame, key: str, ts: str, fact: str, seconds: float = 3600.0) -> DataFrame:
    """rows with `fact`: that of facts(key, ts, fact) of the same key with the latest time not after the row's, the largest of
    several at one time, null if there is none.

    Facts and rows are sorted together and the last fact is carried forward, within buckets of some seconds; what a bucket
    begins with is carried over one row a bucket. So an address that a third of all rows have is spread over its buckets, and rows
    aren't compared in pairs. Rows with a null key or time have no fact.
    """
    place = lambda df: df.withColumn("__bucket", F.floor(F.col(ts) / seconds))
    facts = place(facts.select(key, ts, fact).where(f"{key} IS NOT NULL AND {ts} IS NOT NULL AND {fact} IS NOT NULL"))
    names = rows.columns
    own = place(rows.select(key, ts, F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")))
    both = own.withColumn(fact, F.lit(None).cast(facts.schema[fact].dataType)).unionByName(facts, allowMissingColumns=True)
    inside = Window.partitionBy(key, "__bucket").orderBy(ts, F.col("__row").isNotNull(), fact).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = facts.groupBy(key, "__bucket").agg(F.max(F.struct(ts, fact))[fact].alias("__last"))
    asked = own.select(key, "__bucket").distinct().withColumn("__last", F.lit(None).cast(facts.schema[fact].dataType)).withColumn("__asked", F.lit(True))
    carried = Window.partitionBy(key).orderBy("__bucket", F.col("__asked").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    begin = asked.unionByName(latest, allowMissingColumns=True).withColumn("__begin", F.last("__last", True).over(carried)).where("__asked").select(key, "__bucket", "__begin")
    found = both.withColumn(fact, F.last(fact, True).over(inside)).where("__row IS NOT NULL")
    joined = found.join(begin, [key, "__bucket"], "left").select("__row", F.coalesce(fact, "__begin").alias(fact))
    return joined.select(*[F.col("__row")[c].alias(c) for c in names if c != fact], fact)


def during(rows: DataFrame, windows: DataFrame, ts: str, start: str, end: str, seconds: float = 3600.0, key: list[str] | None = None) -> DataFrame:
    """Pairs of rows(ts) and windows(start, end) where start <= ts <= end, with equal key columns if any are given.

    A window is repeated for each bucket of some seconds that it reaches into, a row has one bucket: an equi-join with the exact
    condition behind it, and no pair twice. Choose buckets about as long as windows are. Names of both sides must differ, but
    for the key. Rows without a time and windows without a bound match nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    spread = windows.where(f"{start} <= {end}").withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    placed = rows.withColumn("__bucket", bucket(ts))
    joined = placed.join(spread, ["__bucket", *(key or [])])
    return joined.where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("__bucket")


def owners(dhcp: DataFrame, arp: DataFrame, dns: DataFrame) -> DataFrame:
    """What has been said of addresses: ip, ts, owner. DHCP acknowledgements and ARP replies name hardware, DNS answers a name."""
    said = lambda kind, c: F.concat(F.lit(kind), c)
    leases = dhcp.where("assigned_ip <> ''").select("file", F.col("assigned_ip").alias("ip"), "ts", said("dhcp ", F.concat_ws(" ", "client_mac", F.nullif("hostname", F.lit("")))).alias("owner"))
    claims = arp.where("kind = 'reply'").select("file", F.col("sender_ip").alias("ip"), "ts", said("arp ", F.col("sender_mac")).alias("owner"))
    names = dns.where("is_response AND answer_type IN ('A', 'AAAA')").select("file", F.explode("answers").alias("ip"), "ts", said("dns ", F.col("name")).alias("owner"))
    return leases.unionByName(claims).unionByName(names)


def owned(packets: DataFrame, facts: DataFrame, address: str = "src", seconds: float = 3600.0) -> DataFrame:
    """packets with the owner of an address at the packet's time, so that an address given to another host counts for each in turn."""
    one = lambda df, c: df.withColumn("__who", F.struct("file", F.col(c).alias("ip")))
    return as_of(one(packets, address), one(facts, "ip"), "__who", "ts", "owner", seconds).drop("__who")


def finding_packets(findings: DataFrame, packets: DataFrame, seconds: float = 600.0) -> DataFrame:
    """id, file, frame of the packets of a finding's hosts within its times."""
    spans = findings.where("first_ts IS NOT NULL").select("id", F.explode("hosts").alias("host"), "first_ts", F.coalesce("last_ts", "first_ts").alias("until_ts"))
    ends: Column = F.explode(F.array_distinct(F.array("src", "dst"))).alias("host")
    return during(packets.select("file", "frame", "ts", ends), spans, "ts", "first_ts", "until_ts", seconds, ["host"]).select("id", "file", "frame").distinct()
