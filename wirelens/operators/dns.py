"""DNS statistics. dns rows: frame, ts, client, server, name, qtype, is_response, response_code, answers, answer_type, ttl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import net, text

# Thresholds of the DNS signals.
LONG_LABEL, HIGH_ENTROPY, MANY_SUBDOMAINS, TXT_BULK, NXDOMAIN_BULK = 32, 3.6, 25, 4, 15
TXT_LENGTH, TXT_ENTROPY = 60, 4.2


def dns_totals(dns: DataFrame) -> DataFrame:
    return dns.agg(
        F.count_if(~F.col("is_response")).alias("queries"), F.count_if("is_response").alias("responses"), F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"),
        F.coalesce(F.sum(F.when(F.col("answer_type") == "TXT", F.size("answers")).otherwise(0)), F.lit(0)).cast("long").alias("txt_answers"),
    )


def with_domain(dns: DataFrame) -> DataFrame:
    """Names with their domain and label facts, computed once for every use below."""
    ls = text.labels(F.col("name"))
    long_labels = F.filter(ls, lambda x: F.length(x) >= 8)
    return dns.where("name <> ''").select(
        "*",
        text.base_domain(F.col("name")).alias("domain"),
        F.array_max(F.transform(ls, lambda x: F.length(x))).alias("longest"),
        F.coalesce(F.array_max(F.transform(long_labels, text.entropy)), F.lit(0.0)).alias("label_entropy"),
        text.subdomain(F.col("name")).alias("sub"),
        net.is_well_known_query(F.col("name")).alias("well_known"),
    )


def domain_stats(named: DataFrame) -> DataFrame:
    """By domain over with_domain(dns): queries, failures, distinct names under it, longest label, entropy, query types."""
    ipv4 = (F.col("answer_type") == "A") | F.exists("answers", lambda x: x.rlike(net.V4))
    resolved = F.when(ipv4, F.filter("answers", lambda x: ~x.contains(":") & x.rlike("^[0-9]"))).otherwise(F.array().cast("array<string>"))
    types = named.groupBy("domain", "qtype").agg(F.count(F.lit(1)).alias("n")).groupBy("domain").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("qtype", "n")))).alias("query_types")
    )
    agg = named.groupBy("domain").agg(
        F.count_if(~F.col("is_response")).alias("queries"), F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"),
        F.count_distinct("sub").alias("subdomains"), F.max("longest").alias("longest_label"), F.max("label_entropy").alias("max_entropy"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(resolved)))).alias("resolved_ips"), F.min("frame").alias("first_frame"),
    )
    return agg.join(types, "domain")


def tunnel_signals(named: DataFrame) -> DataFrame:
    """By domain: the signals of data in names, over names that aren't service discovery.

    A domain without a query, or with service discovery only, has no row; signals counts those that fire, with
    the look of the first three names added only to another signal.
    """
    first = named.groupBy("domain", "name").agg(F.min("frame").alias("f"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("f", "name"))).where("k <= 3")
    label = text.labels(F.col("name"))[0]
    look = text.looks_like_base32(label) | text.looks_like_hex(label)
    examples = ranked.groupBy("domain").agg(F.max(look).alias("encoded_look"), F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("examples"))
    asked = named.groupBy("domain").agg(
        F.count_if(~F.col("is_response")).alias("queries"), F.sort_array(F.collect_set("client")).alias("hosts"), F.min("ts").alias("first_ts"), F.min("frame").alias("first_frame")
    )
    txt = F.when((F.col("answer_type") == "TXT") | (F.col("qtype") == "TXT"), F.size("answers")).otherwise(0)
    active = named.where(~F.col("well_known")).groupBy("domain").agg(
        F.count_distinct("name").alias("names"), F.max("longest").alias("longest_label"), F.max("label_entropy").alias("max_entropy"),
        F.count_distinct("sub").alias("subdomains"), F.sum(txt).cast("long").alias("txt"),
    )
    base = sum(
        (
            (F.col(c) >= v).cast("int")
            for c, v in (("longest_label", LONG_LABEL), ("max_entropy", HIGH_ENTROPY), ("subdomains", MANY_SUBDOMAINS), ("txt", TXT_BULK))
        ),
        F.lit(0),
    )
    joined = active.join(asked.where("queries > 0"), "domain").join(examples, "domain")
    return joined.withColumn("signals", F.when(base > 0, base + F.col("encoded_look").cast("int")).otherwise(0))


def nxdomain_rates(named: DataFrame) -> DataFrame:
    """By domain: failures over all records and over those that aren't service discovery, and whether both are high."""
    agg = named.groupBy("domain").agg(
        F.count_if(~F.col("is_response")).alias("queries"), F.count_if(F.col("response_code") == "NXDOMAIN").alias("nxdomain"),
        F.count_if(~F.col("well_known")).alias("active"), F.count_if(~F.col("well_known") & (F.col("response_code") == "NXDOMAIN")).alias("active_nx"),
        F.sort_array(F.collect_set("client")).alias("hosts"), F.min("frame").alias("first_frame"),
    )
    high = (
        (F.col("nxdomain") >= NXDOMAIN_BULK) & (F.col("queries") > 0) & (2 * F.col("nxdomain") >= F.col("queries")) & (F.col("active_nx") >= NXDOMAIN_BULK) & (2 * F.col("active_nx") >= F.col("active"))
    )
    return agg.withColumn("anomaly", high)


def suspicious_txt(named: DataFrame) -> DataFrame:
    """TXT values that look encoded."""
    values = named.where("answer_type = 'TXT'").select("domain", "client", "frame", F.explode("answers").alias("value"))
    dense = text.looks_like_base32(F.upper("value")) | (text.entropy(F.col("value")) >= TXT_ENTROPY)
    return values.where((F.length("value") >= TXT_LENGTH) & dense)
