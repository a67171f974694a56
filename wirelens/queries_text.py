"""Queries over texts, value sequences and findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.lookups import SEVERITY_WEIGHT
from .operators import covert, findings, flows, intervals, rules, streams
from .queries_net import _CONV_SQL, _GRADE, _INTERVAL_SQL, _tcp_intervals, rounded
from .queries_net import query as _register
from .session import table
from .sources.adapters import PACKETS_SQL, packets_from_events
from .sources.rules import load_rules

query = _register
RULES = load_rules()


def _sql_string(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The shell rule for RE2, whose word boundary doesn't see accented letters as letters: the characters around a word are
#: matched too, with all white space doubled so that two words may stand next to each other.
_SHELL = "interesting.shell-command"
_SHELL_SQL = r"(?im)(?:^|[^\pL\pN_])((?:curl|wget|nc|ncat|bash\s\s-i|sh\s\s-i|powershell\s\s-enc|certutil\s\s-urlcache|chmod\s\s\+x)(?:[!-/:-@\[-^`{-~][!-~]{0,119})?)(?:[^!-~\pL\pN]|$)"


def _rule_sql(of: str, id_: str, column: str) -> str:
    parts = []
    for r in RULES.values():
        value = f"unnest(regexp_extract_all({column}, {_sql_string('(?m)' + r.pattern)}, {r.group}))"
        if r.id == _SHELL:
            doubled = f"regexp_replace({column}, '(\\s)', '\\1\\1', 'g')"
            value = f"replace(unnest(regexp_extract_all({doubled}, {_sql_string(_SHELL_SQL)}, 1)), '  ', ' ')"
        parts.append(f"SELECT {id_}, {_sql_string(r.id)} AS rule, {_sql_string(r.kind)} AS kind, {_sql_string(r.confidence)} AS confidence, {r.score} AS score, {value} AS value FROM {of}")
    return " UNION ALL ".join(parts)


@query(_rule_sql("documents", "doc_id", "text"))
def rule_scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), RULES.values())


@query(_rule_sql("pages", "page_id", "html"))
def rule_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), RULES.values())


@query(f"SELECT rule, kind, count(*) AS hits, count(DISTINCT value) AS distinct_values FROM ({_rule_sql('pages', 'page_id', 'html')}) GROUP BY rule, kind")
def rule_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rule_scan_pages(spark, sf_dir)
    return hits.groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("value").alias("distinct_values"))


def rule_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All builtin rules over documents and conversations; word ends differ between engines, so there is no SQL."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("source"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.format_string("conversation %d turn %d", "conv_id", "turn").alias("source"), "text")
    return rules.distinct_hits(rules.scan(docs.unionByName(turns), RULES.values()), ["source"])


_register()(rule_scan_all)

_SCORE_SQL = r"""(least(len(s), 60) // 6 + CASE WHEN regexp_matches(s, '(?i)\b(password|passwd|pwd|secret|token|api[_\-]?key|flag|auth|credential|login|session|admin|root|private|key|bearer)\b') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(s, '(?i)\.(?:zip|rar|7z|gz|tar|exe|dll|so|bin|php|asp|jsp|py|pl|sh|pdf|docx?|xlsx?|pptx?|csv|json|xml|conf|cfg|ini|env|pem|key|pcap)$') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(s, '^[A-Za-z0-9+/=]{16,}$') OR regexp_matches(s, '^[0-9a-fA-F]{16,}$') THEN floor(list_entropy(string_split(s, '')) * 4 + 1e-12) ELSE 0 END
 + CASE WHEN starts_with(ltrim(s, ' '), '<') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(s, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') THEN 12 ELSE 0 END
 + CASE WHEN regexp_matches(s, '^(https?|ftp)://') THEN 10 ELSE 0 END)::BIGINT"""


@query(f"SELECT doc_id, s AS value, {_SCORE_SQL} AS score FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\\x20-\\x7e]{{6,}}')) AS s FROM documents)")
def string_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.printable_strings(docs)


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '(password|secret|token|api_key|login|admin|private)'))::BIGINT AS keywords FROM documents")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_count(F.lower("text"), F.lit("(password|secret|token|api_key|login|admin|private)"))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("keywords"))


_ENCODED = "SELECT doc_id, base64(encode(text)) AS b64, lower(hex(encode(text))) AS hexed, replace(text, ' ', '%20') AS url FROM documents"


@query(f"""SELECT doc_id, (regexp_matches(b64, '^[A-Za-z0-9+/=]+$') AND len(b64) % 4 = 0 AND len(rtrim(b64, '=')) >= 8) AS is_base64, (regexp_matches(hexed, '^[0-9a-fA-F]{{8,}}$') AND len(hexed) % 2 = 0) AS is_hex,
len(regexp_extract_all(url, '%[0-9A-Fa-f]{{2}}')) >= 2 AS is_url, decode(from_base64(b64)) AS from_b64, decode(unhex(hexed)) AS from_hex FROM ({_ENCODED})""")
def encoding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One encoding step, recognised and undone: base64, hex and URL forms of whole texts."""
    d = table(spark, sf_dir, "documents")
    e = d.select(
        "doc_id", F.base64(F.encode("text", "UTF-8")).alias("b64"), F.lower(F.hex(F.encode("text", "UTF-8"))).alias("hexed"), F.regexp_replace("text", " ", "%20").alias("url")
    )
    e = e.withColumn("b64", F.regexp_replace("b64", "[\r\n]", ""))
    return e.select(
        "doc_id", text.looks_like_base64(F.col("b64")).alias("is_base64"), text.looks_like_hex(F.col("hexed")).alias("is_hex"), text.looks_like_url_encoded(F.col("url")).alias("is_url"),
        F.decode(F.unbase64("b64"), "UTF-8").alias("from_b64"), F.decode(F.unhex("hexed"), "UTF-8").alias("from_hex"),
    )


def encoding_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in two layers of encodings, and back."""
    from .operators import extract

    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.base64(F.encode(F.lower(F.hex(F.encode("text", "UTF-8"))), "UTF-8")), "[\r\n]", "").alias("value"))
    return extract.encoding_chains(d).select("doc_id", "steps", "final", "printable")


def xor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags under a one-byte XOR: whole texts, each behind a flag of its number under a key that its number gives."""
    from .operators import extract

    key = (F.col("doc_id") % 255 + 1).cast("int")
    flag = F.concat(F.lit("..flag{doc_"), F.col("doc_id").cast("string"), F.lit("}.."))
    chars = F.transform(F.filter(F.split(flag, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c).bitwiseXOR(key)), 2, "0"))
    data = F.concat(F.unhex(F.array_join(chars, "")), F.coalesce("text", F.lit("")).cast("binary"))
    return extract.xor_sweep(table(spark, sf_dir, "documents").select("doc_id", data.alias("data")))


_register()(encoding_chain)
_register("SELECT doc_id, (doc_id % 255 + 1)::INT AS key, 'flag{doc_' || doc_id || '}' AS value FROM documents")(xor_sweep)


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.sha1(t).alias("sha1"), F.md5(t).alias("md5"))


@query("""SELECT doc_id, CASE WHEN len(w) <= 12 THEN w ELSE substr(w, 1, 8) || '…' || right(w, 4) END AS secret,
CASE WHEN len(v) <= 2 THEN repeat('*', len(v)) ELSE left(v, 1) || '…' || right(v, 1) || ' (' || len(v) || ' chars)' END AS password
FROM (SELECT doc_id, regexp_extract(text, '^([^\\x20\\x09-\\x0D]*)', 1) AS v, sha1(text) AS w FROM documents)""")
def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"^([^\x20\x09-\x0D]*)", 1).alias("v"), F.sha1(F.col("text").cast("binary")).alias("w"))
    return d.select("doc_id", text.mask_secret(F.col("w")).alias("secret"), text.mask_password(F.col("v")).alias("password"))


@query(r"""SELECT page_id, CASE WHEN f = '' THEN 'unnamed' ELSE f END AS filename FROM (SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1),
'[^A-Za-z0-9._\- ]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), '\s+', '_', 'g'), 1, 100) AS f FROM pages)""")
def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_filename(F.col("url")).alias("filename"))


@query("""SELECT 'page' AS kind, page_id AS id, CASE WHEN starts_with(html, '<!DOCTYPE html') THEN 'HTML document' ELSE 'other' END AS type FROM pages
UNION ALL SELECT 'hash', doc_id, 'text' FROM documents""")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.detect_type(F.col("html").cast("binary")).alias("type"))
    docs = table(spark, sf_dir, "documents").select(F.lit("hash").alias("kind"), F.col("doc_id").alias("id"), text.detect_type(F.md5(F.col("text").cast("binary")).cast("binary")).alias("type"))
    return pages.unionByName(docs)


@query("SELECT doc_id, round(len(regexp_extract_all(text, '[\\x20-\\x7e\\t\\n\\r]')) / len(text), 6) AS ratio FROM documents WHERE len(text) > 0")
def printable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", text.printable_ratio(F.col("text")).alias("ratio")))


@query("SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM') AS rot13 FROM documents")
def rot13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.rot13(F.col("text")).alias("rot13"))


@query("""SELECT doc_id, CASE WHEN n = 0 THEN '0' WHEN n < 10 THEN '1-9' WHEN n < 100 THEN '10-99' WHEN n < 1000 THEN '100-999' ELSE '1000+' END AS length_class,
CASE WHEN n < 1024 THEN n || ' B' ELSE format('{:.1f} KiB', n / 1024.0) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.length_class(n).alias("length_class"), text.format_bytes(n).alias("size"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type").isin("click", "view"), F.lit("browse")).otherwise(F.lit("act"))
    return e.select(
        F.lit("events").alias("protocol"), F.lit("kind").alias("field"), F.col("user_id").cast("string").alias("source"), (F.row_number().over(w) - 1).alias("pos"), kind.alias("value"),
        F.col("event_id").cast("double").alias("ts"), (F.col("event_id") + 1).alias("frame"),
    )


_SEQ_SQL = """seq AS (SELECT user_id::VARCHAR AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CASE WHEN event_type IN ('click', 'view') THEN 'browse' ELSE 'act' END AS value FROM events),
changes AS (SELECT *, coalesce((value <> lag(value) OVER (PARTITION BY source ORDER BY pos))::INT, 0) AS change FROM seq),
runs AS (SELECT *, sum(change) OVER (PARTITION BY source ORDER BY pos) AS run FROM changes),
run_len AS (SELECT source, run, count(*) AS n, any_value(value) AS value FROM runs GROUP BY source, run),
vals AS (SELECT source, value, sum(n) AS c FROM run_len GROUP BY source, value),
tot AS (SELECT source, sum(c)::BIGINT AS length, count(*) AS cardinality, sum(c * c) / (sum(c) * sum(c))::DOUBLE AS psq FROM vals GROUP BY source),
rr AS (SELECT source, count(*) - 1 AS transitions, max(n)::BIGINT AS max_run FROM run_len GROUP BY source),
variation AS (SELECT tot.source, length, cardinality, transitions, max_run, greatest((length - 1) * (1 - psq), 1e-9) AS expected FROM tot JOIN rr USING (source))"""


@query(f"WITH {_SEQ_SQL} SELECT source, length, cardinality, transitions, max_run, round(expected, 6) AS expected FROM variation")
def variation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(covert.variation(_sequences(spark, sf_dir)).select("source", "length", "cardinality", "transitions", "max_run", "expected"))


@query(f"""WITH {_SEQ_SQL}, wanted AS (SELECT source, length FROM variation WHERE length >= 16 AND cardinality = 2 AND transitions / expected >= 0.4995 AND max_run <= greatest(8, length / 4)),
first AS (SELECT source, value AS zero FROM seq WHERE pos = 0),
bits AS (SELECT seq.source, pos, length, (value <> zero)::INT AS bit FROM seq JOIN wanted USING (source) JOIN first USING (source) WHERE pos < length - length % 8),
bytes AS (SELECT source, pos // 8 AS i, sum(bit << (7 - pos % 8)::INT)::BIGINT AS byte FROM bits GROUP BY source, i)
SELECT source, count(*) AS byte_len, string_agg(lpad(to_hex(byte), 2, '0'), '' ORDER BY i) AS hex FROM bytes GROUP BY source""")
def covert_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of the sequences that look chosen, by first appearance, most significant first."""
    obs = _sequences(spark, sf_dir)
    out = covert.decode(obs, covert.variation(obs)).where("mapping = 0 AND bit_order = 'msb' AND pad = 'trailing'")
    return out.select("source", "byte_len", F.hex(F.encode("decoded", "ISO-8859-1")).alias("hex"))


def covert_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that decode to text; the event log has none."""
    return covert.candidates(_sequences(spark, sf_dir)).select("protocol", "field", "source", "decoded", "printable", "confidence")


_register()(covert_candidates)

_SEG_SQL = f"""{PACKETS_SQL}, seg AS (SELECT src, frame, row_number() OVER (PARTITION BY src ORDER BY frame) AS k, payload_len % 40 + 1 AS len FROM packets WHERE proto = 'tcp'),
pos AS (SELECT src, frame, (k * 25 + k % 3 * 7)::BIGINT AS rel, len FROM seg),
best AS (SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY src, rel ORDER BY len DESC, frame) = 1),
cur AS (SELECT *, coalesce(max(rel + len) OVER (PARTITION BY src ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM best)"""


@query(f"WITH {_SEG_SQL} SELECT src, sum((rel > cur)::INT)::BIGINT AS gaps, sum(greatest(rel + len - greatest(cur, rel), 0))::BIGINT AS bytes FROM cur GROUP BY src")
def reassembly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a source as overlapping and missing segments of one direction, put together."""
    from pyspark.sql.window import Window

    p = packets_from_events(spark, sf_dir).where("proto = 'tcp'")
    k = F.row_number().over(Window.partitionBy("src").orderBy("frame"))
    segs = p.select("src", "frame", k.alias("k"), (F.col("payload_len") % 40 + 1).alias("len")).select(
        "src", "frame", (F.expr("4294967290L + k * 25 + k % 3 * 7") % 4294967296).alias("seq"), F.lit(4294967290).alias("base"), F.repeat(F.lit("x"), F.col("len")).cast("binary").alias("payload")
    )
    parts = streams.chunks(segs, ["src"])
    return parts.groupBy("src").agg(F.sum("gap").cast("long").alias("gaps"), F.sum(F.octet_length("chunk")).cast("long").alias("bytes"))


def _some_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    beacons = intervals.beacon_verdict(_tcp_intervals(spark, sf_dir)).where("severity IS NOT NULL").select(
        F.concat_ws(".", F.lit("beacon.tcp"), "src", "dst", F.col("dport").cast("string")).alias("id"), "severity", "confidence"
    )
    sweeps = flows.flows(packets_from_events(spark, sf_dir)).where("proto = 'tcp' AND syn_count > 0").groupBy("src", "dport").agg(F.count_distinct("dst").alias("n")).where("n >= 20").select(
        F.concat_ws(".", F.lit("scan.host"), "src", F.col("dport").cast("string")).alias("id"), F.lit("MEDIUM").alias("severity"), F.lit("medium").alias("confidence")
    )
    bulk = flows.conversations(packets_from_events(spark, sf_dir)).where("bytes >= 500").select(F.concat_ws(".", F.lit("beacon.tcp"), "a", "b", F.col("service_port").cast("string")).alias("id"), F.lit("LOW").alias("severity"), F.lit("low").alias("confidence"))
    return beacons.unionByName(sweeps).unionByName(bulk)


_W = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_WEIGHT.items()) + " END"
_C = "CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END"
_FIND_SQL = f"""WITH {_INTERVAL_SQL}, conv AS ({_CONV_SQL.split('conv AS (', 1)[1].rsplit(')', 1)[0]}), agg2 AS (SELECT src, dport, count(DISTINCT dst) AS n FROM packets WHERE proto = 'tcp' AND tcp_flags = 'S' GROUP BY src, dport),
found AS (
  SELECT 'beacon.tcp.' || src || '.' || dst || '.' || dport AS id, CASE g WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE g WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, {_GRADE} AS g FROM full_stats) WHERE g IS NOT NULL
  UNION ALL SELECT 'scan.host.' || src || '.' || dport, 'MEDIUM', 'medium' FROM agg2 WHERE n >= 20
  UNION ALL SELECT 'beacon.tcp.' || a || '.' || b || '.' || service_port, 'LOW', 'low' FROM conv WHERE bytes >= 500
), ranked AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_W} DESC, {_C} DESC) = 1)"""


@query(f"{_FIND_SQL} SELECT id, severity, confidence FROM ranked")
def findings_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.ranked(_some_findings(spark, sf_dir))


@query(f"{_FIND_SQL}, c AS (SELECT {_W} * {_C} AS c FROM ranked) SELECT least(100, round_even(max(c) + 0.25 * (sum(c) - max(c)), 0))::INT AS score, CASE WHEN max(c) + 0.25 * (sum(c) - max(c)) >= 79.5 THEN 'critical' ELSE 'other' END AS label FROM c")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.risk_score(findings.ranked(_some_findings(spark, sf_dir)))


@query(f"{_FIND_SQL} SELECT severity, count(*) AS findings FROM ranked GROUP BY severity")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.severity_breakdown(findings.ranked(_some_findings(spark, sf_dir)))


@query(f"""WITH {PACKETS_SQL}, parts AS (
  (SELECT 'dns' AS kind, ts, src AS host, 'INFO' AS severity, 'query ' || frame AS text FROM packets WHERE dport = 53 ORDER BY ts LIMIT 300)
  UNION ALL (SELECT 'stream', ts, src, 'LOW', 'stream ' || frame FROM packets WHERE tcp_flags = 'S' ORDER BY ts LIMIT 200))
SELECT kind, round(ts, 6) AS ts, host, severity, text FROM parts ORDER BY ts, kind, text LIMIT 600""")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets_from_events(spark, sf_dir)
    frame = F.col("frame").cast("string")
    parts = {
        "dns": p.where("dport = 53").select("ts", F.col("src").alias("host"), F.lit("INFO").alias("severity"), F.concat(F.lit("query "), frame).alias("text")),
        "stream": p.where("tcp_flags = 'S'").select("ts", F.col("src").alias("host"), F.lit("LOW").alias("severity"), F.concat(F.lit("stream "), frame).alias("text")),
    }
    return rounded(findings.timeline(parts))


# --- beyond the packet model: the same plans over the star tables


@query("""SELECT n_name, c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY CUBE (n_name, c_mktsegment)""")
def cube_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rounded(j.cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("revenue")), 2)


@query("SELECT l_suppkey, count(DISTINCT o_custkey) AS peers, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey")
def supplier_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as the two ends of conversations."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_suppkey").agg(F.count_distinct("o_custkey").alias("peers"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') INTERSECT SELECT o_custkey FROM orders")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    rest = c.join(o.where("o_orderstatus = 'F'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
    return rest.intersect(o.select("o_custkey"))
