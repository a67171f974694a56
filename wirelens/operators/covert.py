"""Covert channels in freely chosen fields: is a field's sequence of values chosen, and does it decode?

Sequences are rows (protocol, field, source, pos, value, ts, frame). Statistics are windows and sums; symbols are
turned into bits and bits into bytes by arithmetic on positions, so no sequence is handled in one piece before its
bytes are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import net, text
from .flows import per_capture
from .limits import Limits

KEY = ("protocol", "field", "source")


def _key(df: DataFrame) -> list[str]:
    return per_capture(df, *KEY)


# Thresholds of interest and of reports.
MIN_OBSERVATIONS, MIN_RATIO, MAX_CARDINALITY = 16, 0.5, 8
MIN_SCORE, MIN_PRINTABLE, MIN_PRINTABLE_SHORT, SHORT_OUTPUT, MAX_CANDIDATES = 0.72, 0.85, 0.95, 8, 8
# Words that raise a decoded text's score.
SCORE_WORDS = ("flag", "ctf", "the ", "pass", "secret", "covert", "channel", "admin", "hello", "{", "}", "pico")
HOSTNAME = r"(?i)^(?=.{1,253}$)(?!-)[a-z0-9-]{1,63}(\.[a-z0-9-]{1,63})*\.(?:[a-z]{2,24}|xn--[a-z0-9-]{2,59})$"


def _observe(df: DataFrame, protocol: str, source: Column, fields: dict[str, tuple[Column, Column]], order: list[str], most: int | None) -> DataFrame:
    """Rows of several fields from one scan, the first `most` of each sequence. fields: name -> (value, condition)."""
    obs = F.array(*[F.struct(F.lit(n).alias("field"), F.when(cond, v.cast("string")).alias("value")) for n, (v, cond) in fields.items()])
    file = per_capture(df)
    rows = df.select(*file, F.lit(protocol).alias("protocol"), source.alias("source"), *order, "ts", F.explode(obs).alias("o")).select(*file, "protocol", "o.field", "source", *order, "ts", "o.value")
    pos = F.row_number().over(Window.partitionBy(*_key(rows)).orderBy(*order)) - 1
    rows = rows.where("value IS NOT NULL").withColumn("pos", pos)
    return rows if most is None else rows.where(F.col("pos") < most)


def http_fields(http: DataFrame, most: int | None = Limits.observations) -> DataFrame:
    yes = F.lit(True)
    size = F.when(F.col("method").isin("POST", "PUT"), F.col("req_body_len")).otherwise(F.greatest("resp_body_len", F.lit(0)))
    fields = {
        "request version": (F.col("version"), yes),
        "request method": (F.col("method"), yes),
        "response status code": (F.col("status"), yes),
        "User-Agent": (F.col("user_agent"), F.col("user_agent") != ""),
        "Host header": (F.col("host"), yes),
        "request header count": (F.col("header_count"), yes),
        "first cookie name": (F.trim(F.substring_index("cookies", "=", 1)), F.col("cookies") != ""),
        "body length class": (text.length_class(size), yes),
    }
    out = _observe(http, "http", F.col("client"), fields, ["stream", "n"], most)
    return out.select(*_key(out), "pos", "value", "ts", F.lit(0).cast("long").alias("frame"))


def dns_fields(dns: DataFrame, most: int | None = Limits.observations) -> DataFrame:
    yes = F.lit(True)
    count = F.when(F.col("name") == "", 0).otherwise(F.size(text.labels(F.col("name"))))
    fields = {
        "query type": (F.col("qtype"), yes),
        "label count": (count, yes),
        "name length class": (text.length_class(F.length("name")), yes),
        "response TTL class": (text.ttl_class(F.col("ttl")), F.col("is_response")),
    }
    out = _observe(dns, "dns", F.col("client"), fields, ["frame"], most)
    return out.select(*_key(out), "pos", "value", "ts", "frame")


def tcp_ip_fields(packets: DataFrame, most: int | None = Limits.observations) -> DataFrame:
    """Header fields of internal sources. IP ids that count up, and TTLs of many values, are the sender's stack at work."""
    own = packets.where(F.col("proto").isin("tcp", "udp") & (F.col("src") != "") & net.is_internal(F.col("src")))
    sender = per_capture(packets, "src")
    w = Window.partitionBy(*sender).orderBy("frame")
    step = F.col("ip_id") - F.lag("ip_id").over(w)
    ids = own.where("ip_id >= 0").withColumn("step", step).groupBy(*sender).agg(
        F.count(F.lit(1)).alias("n_ids"), *[F.count_if((F.col("step") > 0) & (F.col("step") <= s)).alias(f"up{s}") for s in (1, 2, 256)]
    )
    rest = own.groupBy(*sender).agg(F.count_if(F.col("tcp_flags") != "").alias("n_tcp"), F.count_if(F.col("ip_ttl") > 0).alias("n_ttl"), F.count_distinct(F.when(F.col("ip_ttl") > 0, F.col("ip_ttl"))).alias("ttls"))
    facts = rest.join(ids, sender, "left")
    j = own.join(facts, sender)
    tcp = (F.col("tcp_flags") != "") & (F.col("n_tcp") >= MIN_OBSERVATIONS)
    up = F.greatest("up1", "up2", "up256")
    counting = (F.col("n_ids") >= 4) & (up >= 0.9 * (F.col("n_ids") - 1))
    fields = {
        "destination port": (F.col("dport"), tcp),
        "TCP flag set": (F.col("tcp_flags"), tcp),
        "frame length class": (text.length_class(F.col("frame_len")), tcp),
        "IP ID parity": (F.col("ip_id") % 2, (F.col("ip_id") >= 0) & (F.col("n_ids") >= MIN_OBSERVATIONS) & ~counting),
        "IP TTL": (F.col("ip_ttl"), (F.col("ip_ttl") > 0) & (F.col("n_ttl") >= MIN_OBSERVATIONS) & (F.col("ttls") <= 8)),
    }
    out = _observe(j, "tcp", F.col("src"), fields, ["frame"], most)
    return out.select(*_key(out), "pos", "value", "ts", "frame")


def variation(obs: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """By sequence: length, cardinality, transitions, what chance would give, their ratio, longest run, entropy, pattern."""
    key = list(key) or _key(obs)
    w = Window.partitionBy(*key).orderBy("pos")
    change = F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(0))
    runs = obs.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    run_len = runs.groupBy(*key, "run").agg(F.count(F.lit(1)).alias("len"), F.first("value").alias("value"))
    per_value = run_len.groupBy(*key, "value").agg(F.sum("len").alias("c"), F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest"))
    per_key = Window.partitionBy(*key)
    p = F.col("c") / F.sum("c").over(per_key)
    stats = per_value.withColumn("p", p).groupBy(*key).agg(
        F.sum("c").alias("length"), F.count(F.lit(1)).alias("cardinality"), (F.sum("runs") - 1).alias("transitions"), F.max("longest").alias("max_run"),
        F.sum(F.col("p") * F.col("p")).alias("psq"), F.round(F.sum(-F.col("p") * F.log2("p")) + 0.0, 3).alias("entropy"),
        F.min(F.col("value").rlike(HOSTNAME)).alias("all_hostnames"),
    )
    stats = stats.withColumn("expected", F.greatest((F.col("length") - 1) * (1 - F.col("psq")), F.lit(1e-9))).drop("psq")
    stats = stats.withColumn("ratio", F.bround(F.col("transitions") / F.col("expected"), 3))
    switching = F.col("ratio") >= 0.55
    # fixed values: the labels of patterns
    pattern = (
        F.when(F.col("cardinality") < 2, "constant")
        .when((F.col("cardinality") == 2) & switching & (F.col("max_run") <= 8), "two-state repeated sequence")
        .when((F.col("cardinality") == 2) & switching, "two-state sequence (long runs)")
        .when(F.col("cardinality") == 2, "two values, mostly separated")
        .when((F.col("cardinality") <= 8) & switching, F.concat(F.lit("low-cardinality ("), F.col("cardinality").cast("string"), F.lit("-state) repeated sequence")))
        .otherwise("high-cardinality variation")
    )
    wanted = (
        (F.col("length") >= MIN_OBSERVATIONS) & F.col("cardinality").between(2, MAX_CARDINALITY) & (F.col("ratio") >= MIN_RATIO) & (F.col("max_run") <= F.greatest(F.lit(8.0), F.col("length") / 4))
    )
    return stats.withColumn("pattern", pattern).withColumn("interesting", wanted)


def decode(obs: DataFrame, stats: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Every reading of the interesting sequences that don't only name hosts: mapping, bit order, dropped remainder, and
    the bytes with their printable share and score.

    Mappings: the values by first appearance and reversed, for more than two also by frequency; alphabets that are no
    power of two can't be read.
    """
    key = list(key) or _key(obs)
    wanted = stats.where("interesting AND NOT all_hostnames AND cardinality IN (2, 4, 8)").select(*key, "cardinality", "length")
    seq = obs.join(wanted, list(key))
    alphabet = seq.groupBy(*key, "cardinality", "value").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("c"))
    by = lambda *o: F.row_number().over(Window.partitionBy(*key).orderBy(*o)) - 1
    ranks = alphabet.withColumn("r0", by("first")).withColumn("r2", by(F.col("c").desc(), "value")).withColumn("r1", F.col("cardinality") - 1 - F.col("r0"))
    # the frequency order is dropped where it equals another mapping
    same = ranks.groupBy(*key).agg(F.min((F.col("r2") == F.col("r0"))).alias("e0"), F.min(F.col("r2") == F.col("r1")).alias("e1"), F.first("cardinality").alias("k"))
    keep = same.select(*key, ((F.col("k") > 2) & ~F.col("e0") & ~F.col("e1")).alias("third"))
    codes = ranks.join(keep, list(key)).select(*key, "value", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("mapping"), F.col("r0").alias("code")), F.struct(F.lit(1).alias("mapping"), F.col("r1").alias("code")), F.when(F.col("third"), F.struct(F.lit(2).alias("mapping"), F.col("r2").alias("code")))), lambda x: x.isNotNull())).alias("m")).select(*key, "value", "m.*")
    width = F.when(F.col("cardinality") == 2, 1).when(F.col("cardinality") == 4, 2).otherwise(3)
    bits = (
        seq.join(codes, [*key, "value"])
        .withColumn("w", width)
        .withColumn("spare", (F.col("length") * F.col("w")) % 8)
        .selectExpr(*key, "mapping", "length * w AS bits", "spare", "code", "pos", "w", "explode(sequence(0, w - 1)) AS j")
        .selectExpr(*key, "mapping", "bits", "spare", "pos * w + j AS at", "shiftright(code, w - 1 - j) & 1 AS bit")
        .selectExpr(*key, "mapping", "bits", "spare", "at", "bit", "explode(array(0, 1)) AS lead")
        .selectExpr(*key, "mapping", "lead", "bits", "spare", "at - lead * spare AS at", "bit")
        .where("at >= 0 AND at < bits - spare")
    )
    octets = bits.groupBy(*key, "mapping", "lead", "bits", F.expr("CAST(at div 8 AS INT) AS i")).agg(
        F.sum(F.expr("bit * shiftleft(1, CAST(7 - at % 8 AS INT))")).alias("msb"), F.sum(F.expr("bit * shiftleft(1, CAST(at % 8 AS INT))")).alias("lsb")
    )
    both = octets.select(*key, "mapping", "lead", "bits", "i", F.explode(F.create_map(F.lit("msb"), F.col("msb"), F.lit("lsb"), F.col("lsb"))).alias("bit_order", "byte"))
    texts = both.groupBy(*key, "mapping", "lead", "bits", "bit_order").agg(
        F.array_sort(F.collect_list(F.struct("i", F.expr("lpad(hex(byte), 2, '0')").alias("h")))).alias("bs"), F.count(F.lit(1)).alias("byte_len"),
        F.count_if(F.expr("byte BETWEEN 32 AND 126 OR byte IN (9, 10, 13)")).alias("good"), F.count_distinct("byte").alias("kinds"),
    )
    decoded = texts.withColumn("decoded", F.decode(F.unhex(F.array_join(F.transform("bs", lambda b: b["h"]), "")), "ISO-8859-1")).drop("bs")
    words = sum((F.contains(F.lower("decoded"), F.lit(w)).cast("int") for w in SCORE_WORDS), F.lit(0))
    score = (
        F.col("printable") + F.least(words * 0.05, F.lit(0.15)) + F.when(F.col("good") == F.col("byte_len"), 0.1).otherwise(0.0)
        - F.when((F.col("byte_len") > 8) & (F.col("kinds") <= 2), 0.4).otherwise(0.0)
    )
    out = decoded.withColumn("printable", F.col("good") / F.col("byte_len")).withColumn("score", F.least(score, F.lit(1.0)))
    return out.withColumn("pad", F.when(F.col("lead") == 1, "leading").otherwise("trailing")).drop("lead", "good", "kinds")


def candidates(obs: DataFrame) -> DataFrame:
    """The best reading of each sequence that decodes, most printable first, MAX_CANDIDATES at most."""
    key, stats = _key(obs), variation(obs)
    floor = F.when(F.col("byte_len") < SHORT_OUTPUT, MIN_PRINTABLE_SHORT).otherwise(MIN_PRINTABLE)
    good = decode(obs, stats).where((F.col("score") >= MIN_SCORE) & (F.col("printable") >= floor))
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), "mapping", F.col("bit_order").desc(), F.col("pad").desc())
    best = good.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    seen = obs.groupBy(*key).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    joined = best.join(stats, key).join(seen, key)
    confidence = (
        F.when((F.col("cardinality") == 2) & (F.col("ratio") >= 0.8) & (F.col("printable") >= 0.95) & (F.col("byte_len") >= 8), "high")
        .when((F.col("ratio") >= 0.55) & (F.col("printable") >= 0.85), "medium")
        .otherwise("low")
    )
    return joined.withColumn("confidence", confidence).withColumn("decoded", F.substring("decoded", 1, 400)).orderBy(F.col("printable").desc(), *key).limit(MAX_CANDIDATES)


#: name -> a function of the Analysis that gives observations: protocol, field, source, pos, value, ts, frame, and file where packets have it.
EXTRACTORS: dict[str, Callable] = {
    "http": lambda a: http_fields(a.http, a.limits.observations),
    "dns": lambda a: dns_fields(a.dns, a.limits.observations),
    "tcp/ip": lambda a: tcp_ip_fields(a.packets, a.limits.observations),
}


def register_extractor(name: str, extractor: Callable) -> None:
    """Add an extractor of field values; its sequences are judged like any others. What isn't asked for isn't planned."""
    EXTRACTORS[name] = extractor


def observations(a, only: Sequence[str] | None = None) -> DataFrame:
    """The observations of all extractors, or of those named, in one union."""
    parts = [make(a) for name, make in EXTRACTORS.items() if only is None or name in only]
    columns = [c for c in (*per_capture(parts[0]), *KEY, "pos", "value", "ts", "frame")]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out
