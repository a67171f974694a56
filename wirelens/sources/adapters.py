"""Projections of plain tables into packets, DNS records, URLs and scan surfaces.

Captures aren't the only evidence: an event log has sources, times and sizes too. The projections use integer
arithmetic only, so that any SQL engine can state the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: a client per user, a server and port per event type; every fifth event is the reply."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    uid = F.col("user_id")
    client = F.concat(F.lit("10.0."), F.expr("CAST(user_id div 250 AS STRING)"), F.lit("."), (uid % 250 + 1).cast("string"))
    kind = F.create_map(*[F.lit(x) for k, v in {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}.items() for x in (k, v)])[F.col("event_type")]
    server = F.when(kind == 3, F.lit("192.168.7.9")).otherwise(F.concat(F.lit("93.184.216."), (kind + 30).cast("string")))
    port = F.when(kind == 0, 443).when(kind == 1, 53).when(kind == 2, 4444).when(kind == 3, 389).otherwise(80)
    cport = (F.lit(40000) + uid % 500).cast("int")
    reply = F.col("event_id") % 5 == 4
    size = F.floor(F.abs("value")).cast("int")
    flags = F.when(kind == 1, "").when(reply, F.when(F.col("event_id") % 3 == 0, "SA").otherwise("PA")).when(F.col("event_id") % 3 == 0, "S").when(F.col("event_id") % 11 == 0, "FA").otherwise("PA")
    return e.select(
        (F.col("event_id") + 1).alias("frame"),
        (us / 1e6).alias("ts"),
        us.alias("ts_us"),
        F.when(reply, server).otherwise(client).alias("src"),
        F.when(reply, client).otherwise(server).alias("dst"),
        F.lit(4).alias("ip_version"),
        F.concat(F.lit("08:00:27:11:11:"), F.lpad(F.lower(F.hex(uid % 200)), 2, "0")).alias("mac_src"),
        F.lit("00:50:56:22:22:22").alias("mac_dst"),
        F.when(kind == 1, "udp").otherwise("tcp").alias("proto"),
        F.when(reply, port).otherwise(cport).cast("int").alias("sport"),
        F.when(reply, cport).otherwise(port).cast("int").alias("dport"),
        flags.alias("tcp_flags"),
        size.alias("payload_len"),
        (size + 54).alias("frame_len"),
        (F.col("event_id") * 7 % 65536).cast("int").alias("ip_id"),
        (F.lit(60) + uid % 4).cast("int").alias("ip_ttl"),
        F.col("event_type").alias("kind"),
    )


def client_block(ip: Column) -> Column:
    """The block of 250 users that a client of packets_from_events is in: the third part of its name."""
    return F.split_part(ip, F.lit("."), F.lit(3)).try_cast("long")


def address(ip: Column) -> Column:
    """The IPv4 address that a name of packets_from_events stands for. Blocks of users are counted on above 255, and such a name is no
    address: what is over is carried into the second part. Other names are addresses and stay."""
    block = client_block(ip)
    parts = F.shiftright(block, 8).bitwiseAND(F.lit(255)), block.bitwiseAND(F.lit(255)), F.split_part(ip, F.lit("."), F.lit(4))
    return F.when(ip.startswith("10.0."), F.concat_ws(".", F.lit("10"), *[x.cast("string") for x in parts])).otherwise(ip)


def dns_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as DNS records: a name from the URL's path and host, odd pages as the answer."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/[a-z]+/(\d+)", 1)
    pid = F.col("page_id")
    token = F.when(pid % 4 == 0, F.concat(F.upper(F.translate(F.sha2(pid.cast("string"), 256), "0189", "ghij")), F.lit("."))).when(pid % 9 == 0, F.lit("_ldap._tcp.")).otherwise("")
    response = pid % 2 == 1
    txt = pid % 8 == 5
    answers = F.when(~response, F.array().cast("array<string>")).when(txt, F.array(F.upper(F.translate(F.sha2(host, 256), "0189", "ghij")))).otherwise(F.array(F.concat(F.lit("10.0."), F.expr("CAST(page_id div 250 % 6 AS STRING)"), F.lit("."), (pid % 250 + 1).cast("string"))))
    return p.select(
        (pid + 1).alias("frame"),
        pid.cast("double").alias("ts"),
        F.concat(F.lit("10.0.0."), (pid % 250 + 1).cast("string")).alias("client"),
        F.lit("10.0.0.53").alias("server"),
        F.concat(token, F.when(path != "", F.concat(F.lit("p"), path, F.lit("."))).otherwise(""), host).alias("name"),
        F.when(txt, "TXT").when(pid % 3 == 0, "AAAA").otherwise("A").alias("qtype"),
        response.alias("is_response"),
        F.when(response & (pid % 7 == 0), "NXDOMAIN").otherwise("NOERROR").alias("response_code"),
        answers.alias("answers"),
        F.when(~response, "").when(txt, "TXT").otherwise("A").alias("answer_type"),
        F.when(response, pid % 300).otherwise(0).cast("long").alias("ttl"),
    )


PACKETS_SQL = r"""
packets AS (
  SELECT event_id + 1 AS frame, epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS ts_us,
         CASE WHEN event_id % 5 = 4 THEN server ELSE client END AS src, CASE WHEN event_id % 5 = 4 THEN client ELSE server END AS dst,
         '08:00:27:11:11:' || lpad(lower(to_hex(user_id % 200)), 2, '0') AS mac_src, '00:50:56:22:22:22' AS mac_dst,
         CASE WHEN kind_no = 1 THEN 'udp' ELSE 'tcp' END AS proto,
         CASE WHEN event_id % 5 = 4 THEN port ELSE cport END AS sport, CASE WHEN event_id % 5 = 4 THEN cport ELSE port END AS dport,
         CASE WHEN kind_no = 1 THEN '' WHEN event_id % 5 = 4 THEN CASE WHEN event_id % 3 = 0 THEN 'SA' ELSE 'PA' END
              WHEN event_id % 3 = 0 THEN 'S' WHEN event_id % 11 = 0 THEN 'FA' ELSE 'PA' END AS tcp_flags,
         size AS payload_len, size + 54 AS frame_len, (event_id * 7 % 65536)::INT AS ip_id, (60 + user_id % 4)::INT AS ip_ttl, event_type AS kind
  FROM (SELECT *, '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) AS client,
               CASE WHEN kind_no = 3 THEN '192.168.7.9' ELSE '93.184.216.' || (kind_no + 30) END AS server,
               CASE kind_no WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 4444 WHEN 3 THEN 389 ELSE 80 END::INT AS port,
               (40000 + user_id % 500)::INT AS cport, floor(abs(value))::INT AS size
        FROM (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS kind_no FROM events))
)"""

DNS_SQL = r"""
dns AS (
  SELECT page_id + 1 AS frame, page_id::DOUBLE AS ts, '10.0.0.' || (page_id % 250 + 1) AS client, '10.0.0.53' AS server,
         (CASE WHEN page_id % 4 = 0 THEN upper(translate(sha256(page_id::VARCHAR), '0189', 'ghij')) || '.' WHEN page_id % 9 = 0 THEN '_ldap._tcp.' ELSE '' END)
           || (CASE WHEN path <> '' THEN 'p' || path || '.' ELSE '' END) || host AS name,
         CASE WHEN page_id % 8 = 5 THEN 'TXT' WHEN page_id % 3 = 0 THEN 'AAAA' ELSE 'A' END AS qtype, page_id % 2 = 1 AS is_response,
         CASE WHEN page_id % 2 = 1 AND page_id % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END AS response_code,
         CASE WHEN page_id % 2 = 0 THEN []::VARCHAR[] WHEN page_id % 8 = 5 THEN [upper(translate(sha256(host), '0189', 'ghij'))]
              ELSE ['10.0.' || (page_id // 250 % 6) || '.' || (page_id % 250 + 1)] END AS answers,
         CASE WHEN page_id % 2 = 0 THEN '' WHEN page_id % 8 = 5 THEN 'TXT' ELSE 'A' END AS answer_type,
         CASE WHEN page_id % 2 = 1 THEN page_id % 300 ELSE 0 END AS ttl
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/[a-z]+/(\d+)', 1) AS path FROM pages)
)"""
