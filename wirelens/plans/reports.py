"""Reports of an analysis: JSON, Markdown, HTML. Each section is a limited collect; the tables stay in Spark."""

from __future__ import annotations

import datetime
import html
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dns, flows
from .analysis import Analysis

# Rows of a section in JSON.
CAPS = {"dns": 2000, "arp": 2000, "timeline": 1000}


def _rows(df: DataFrame, limit: int) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def summary(a: Analysis) -> dict:
    """The sections of a report, as plain values."""
    creds = a.credentials.select("protocol", "client", "server", "username", text.mask_password(F.col("password")).alias("password"), "kind", "detail", "stream")
    return {
        "capture": _rows(a.meta, 100) if a.path else [],
        "risk": a.risk.first().asDict(),
        "findings": _rows(a.findings, 500),
        "protocols": _rows(flows.protocol_counts(a.packets).orderBy(F.col("packets").desc(), "proto"), 100),
        "applications": _rows(flows.l7_counts(a.packets).orderBy(F.col("packets").desc(), "l7"), 100),
        "hosts": _rows(a.hosts.orderBy("ip"), 500),
        "top_conversations": _rows(flows.top_conversations(a.conversations), 10),
        "dns": _rows(dns.domain_stats(a.dns_named).orderBy(F.col("queries").desc(), "domain"), CAPS["dns"]),
        "http": _rows(a.http.select("stream", "client", "method", "host", "url", "status", "content_type_resp", "resp_body_len").orderBy("stream"), 500),
        "tls": _rows(a.tls.orderBy("stream"), 500),
        "credentials": _rows(creds, 200),
        "secrets": _rows(a.secrets.select("kind", text.mask_secret(F.col("value")).alias("value"), "confidence", "source", "how"), 200),
        "covert": _rows(a.covert, 8),
        "arp": _rows(a.arp, CAPS["arp"]),
        "timeline": _rows(a.timeline, CAPS["timeline"]),
    }


# Ports whose streams aren't unusual, and filters of a group at most.
USUAL_PORTS, MOST_FILTERS = (80, 443, 53, 22, 25), 12


def wireshark_filters(a: Analysis) -> list[dict]:
    """Display filters by group, for reading on in the packet viewer."""

    def group(name: str, df: DataFrame, what: Column, display: Column) -> list[dict]:
        return _rows(df.select(F.lit(name).alias("group"), what.alias("what"), display.alias("filter")).limit(MOST_FILTERS), MOST_FILTERS)

    stream = F.format_string("tcp.stream == %d", "stream")
    changing = a.http.where("method IN ('POST', 'PUT')").select("method").distinct().orderBy("method")
    files = a.http.where("status = 200 AND resp_body_len > 0 AND path <> '/'").select("stream", "n", "path").orderBy("stream", "n")
    odd = a.chunks.where(~F.col("server_port").isin(*USUAL_PORTS) & F.col("side").isNotNull()).select(F.col("index").alias("stream"), "server_port").distinct().orderBy("stream")
    asked = dns.domain_stats(a.dns_named).where("queries >= 3").orderBy(F.col("queries").desc(), "domain")
    return [
        *_rows(a.findings.select(F.lit("finding").alias("group"), F.col("title").alias("what"), F.explode("wireshark_filters").alias("filter")), 200),
        *group("host", flows.top_talkers(a.hosts), F.col("ip"), F.concat(F.lit("ip.addr == "), F.col("ip"))),
        *group("domain", asked, F.col("domain"), F.format_string('dns.qry.name contains "%s"', "domain")),
        *group("credentials", a.credentials.select("stream").distinct().orderBy("stream"), stream, stream),
        *group("state-changing requests", changing, F.col("method"), F.format_string('http.request.method == "%s"', "method")),
        *group("downloads", files, F.col("path"), F.format_string('http.request.full_uri contains "%s"', "path")),
        *group("unusual ports", odd, F.col("server_port").cast("string"), stream),
    ]


def to_json(s: dict) -> str:
    return json.dumps(s, indent=2, ensure_ascii=False, default=lambda v: bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v))


def _cell(v) -> str:
    if isinstance(v, list):
        return ", ".join(map(_cell, v))
    return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def to_markdown(s: dict) -> str:
    out = ["# Capture report", "", f"Risk score: **{s['risk']['score']}** ({s['risk']['label']})", "", "## Findings", ""]
    for f in s["findings"]:
        out += [f"### {f['severity']} / {f['confidence']}: {f['title']}", "", f["description"], "", f"*{f['explanation']}*", ""]
        out += [f"- {e}" for e in f["evidence"]] + [f"- check: `{f['verification']}`", *(f"- ATT&CK {m['technique']} {m['name']}: {m['why']}" for m in f["mitre"]), ""]
    for name, rows in s.items():
        if name in ("risk", "findings") or not rows:
            continue
        cols = [c for c in rows[0] if not isinstance(rows[0][c], bytes | bytearray | dict)]
        out += [f"## {name.replace('_', ' ').capitalize()}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        out += ["| " + " | ".join(_cell(r[c]).replace("|", "\\|").replace("\n", " ") for c in cols) + " |" for r in rows[:50]] + [""]
    return "\n".join(out)


def to_html(s: dict) -> str:
    """One page without scripts; every value is escaped."""
    e = html.escape
    out = [f"<h1>Capture report</h1><p>Risk score <b>{s['risk']['score']}</b> ({e(s['risk']['label'])})</p>"]
    for f in s["findings"]:
        items = "".join(f"<li>{e(x)}</li>" for x in (*f["evidence"], f"check: {f['verification']}", *(f"ATT&CK {m['technique']} {m['name']}" for m in f["mitre"])))
        out.append(f"<section class='{e(f['severity'].lower())}'><h3>{e(f['severity'])}: {e(f['title'])}</h3><p>{e(f['description'])}</p><p><i>{e(f['explanation'])}</i></p><ul>{items}</ul></section>")
    for name, rows in s.items():
        if name in ("risk", "findings") or not rows:
            continue
        cols = [c for c in rows[0] if not isinstance(rows[0][c], bytes | bytearray | dict)]
        head = "".join(f"<th>{e(c)}</th>" for c in cols)
        body = "".join("<tr>" + "".join(f"<td>{e(_cell(r[c]))}</td>" for c in cols) + "</tr>" for r in rows[:50])
        out.append(f"<h2>{e(name.replace('_', ' ').capitalize())}</h2><table><tr>{head}</tr>{body}</table>")
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;font-size:12px}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Capture report</title><style>{style}</style></head><body>{''.join(out)}</body></html>"


FORMATS = {"json": to_json, "markdown": to_markdown, "md": to_markdown, "html": to_html}


def write_report(a: Analysis, path: str, fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown report format {fmt!r}; there are {', '.join(FORMATS)}")
    Path(path).write_text(FORMATS[fmt](summary(a) | {"written": [{"at": datetime.datetime.now(datetime.UTC).isoformat()}]}), encoding="utf-8")
