"""Command line: one view of a capture for each command. Exit code 2 for a file or rule that can't be used."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .functions import text
from .operators import dns, extract, findings, flows, rules
from .plans import reports
from .plans.analysis import Analysis
from .session import local_session
from .sources.rules import RuleError, adhoc_rule



def _show(df: DataFrame, args: argparse.Namespace, limit: int | None = None) -> None:
    rows = [r.asDict(recursive=True) for r in df.limit(limit or args.limit).collect()]
    if args.json:
        print(reports.to_json(rows))
        return
    if not rows:
        print("(nothing)")
        return
    cols = [c for c in rows[0] if not isinstance(rows[0][c], bytes | bytearray)]
    cells = [[str(r[c]) if r[c] is not None else "" for c in cols] for r in rows]
    width = [min(60, max(len(c), *(len(x[k]) for x in cells))) for k, c in enumerate(cols)]
    for line in [cols, *cells]:
        print("  ".join(v[:60].ljust(w) for v, w in zip(line, width)).rstrip())


def _creds(a: Analysis, args: argparse.Namespace) -> DataFrame:
    return a.credentials if args.reveal else a.credentials.withColumn("password", text.mask_password(F.col("password")))


def summary(a: Analysis, args) -> None:
    _show(a.meta, args)
    _show(flows.protocol_counts(a.packets).orderBy(F.col("packets").desc()), args)


def hosts(a: Analysis, args) -> None:
    _show(flows.top_talkers(a.hosts, args.limit), args)
    _show(flows.top_conversations(a.conversations, args.limit), args)


def dns_view(a: Analysis, args) -> None:
    _show(dns.dns_totals(a.dns), args)
    _show(dns.domain_stats(a.dns_named).orderBy(F.col("queries").desc(), "domain"), args)


def http(a: Analysis, args) -> None:
    _show(a.http.drop("req_body", "resp_body").orderBy("stream", "n"), args)


def tls(a: Analysis, args) -> None:
    _show(a.tls.orderBy("stream"), args)


def streams(a: Analysis, args) -> None:
    _show(a.streams.withColumns({"c2s": F.octet_length("c2s"), "s2c": F.octet_length("s2c")}).orderBy("index"), args)


def stream(a: Analysis, args) -> None:
    rows = a.streams.where(F.col("index") == args.number).limit(1).collect()
    if not rows:
        raise LookupError(f"no stream {args.number}")
    for side in ("c2s", "s2c"):
        if args.direction in ("both", side):
            data = bytes(rows[0][side])[: args.max_bytes]
            print(f"--- {side}")
            print(data.hex(" ", 2) if args.hex else data.decode("latin-1"))


def extract_view(a: Analysis, args) -> None:
    if args.output:
        extract.write_artifacts(a.artifacts, args.output).collect()
    _show(a.artifacts.drop("content"), args)


def secrets(a: Analysis, args) -> None:
    _show(rules.masked(a.secrets, args.reveal), args)


def detect(a: Analysis, args) -> None:
    if args.json:
        print(reports.to_json({"risk": a.risk.first().asDict(), "findings": [r.asDict(recursive=True) for r in a.findings.collect()]}))
        return
    _show(a.risk, args)
    _show(a.findings.select("severity", "confidence", "id", "title", *(["description", "evidence"] if args.verbose else [])), args)


def timeline(a: Analysis, args) -> None:
    _show(findings.filter_timeline(a.timeline, args.host, args.kind, args.severity.upper()).orderBy("ts"), args)


def report(a: Analysis, args) -> None:
    out = args.output or f"report.{'md' if args.format == 'markdown' else args.format}"
    reports.write_report(a, out, args.format)
    print(out)


def covert(a: Analysis, args) -> None:
    _show(a.covert, args)


def ctf(a: Analysis, args) -> None:
    """What a flag hunter looks at: flags, decoded strings, XOR, covert channels, files."""
    _show(rules.masked(a.secrets.where("kind IN ('flag', 'custom')"), True), args)
    strings = rules.printable_strings(a.surfaces.select("source", "text"))
    encoded = extract.encoding_chains(rules.top_strings(strings, "source", 25).select("source", "value")).where(F.size("steps") > 0)
    _show(encoded, args)
    sides = a.streams.select("index", F.explode(F.array("c2s", "s2c")).alias("data"))
    _show(extract.xor_sweep(sides), args)
    _show(a.covert.select("protocol", "field", "source", "decoded", "confidence"), args)
    _show(a.artifacts.select("name", "detected_type", "size", "sha256"), args)


def analyze(a: Analysis, args) -> None:
    """The views one after the other."""
    steps: list[tuple[str, Callable]] = [
        ("Capture", summary), ("Hosts and conversations", hosts), ("DNS", dns_view), ("HTTP", http), ("TLS", tls), ("Streams", streams), ("Credentials", lambda a, args: _show(_creds(a, args), args)),
        ("Files", extract_view), ("Secrets", secrets), ("Covert channels", covert), ("Findings", detect),
    ]
    for k, (title, view) in enumerate(steps, 1):
        print(f"\n== {k}/{len(steps)} {title}")
        view(a, args)
    print("\n== Run")
    _show(a.metrics(), args)


COMMANDS: dict[str, Callable] = {
    "analyze": analyze, "summary": summary, "hosts": hosts, "dns": dns_view, "http": http, "tls": tls, "streams": streams, "stream": stream, "extract": extract_view, "secrets": secrets,
    "ctf": ctf, "covert": covert, "detect": detect, "timeline": timeline, "report": report,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wirelens")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("capture", help="capture file, folder or glob that Spark can read")
        p.add_argument("--max-packets", type=int, default=0)
        p.add_argument("--rules", action="append", default=[])
        p.add_argument("--pattern", default="")
        p.add_argument("--dc", action="append", default=[])
        p.add_argument("--reveal", action="store_true")
        p.add_argument("--verbose", "-v", action="store_true")
        p.add_argument("--json", action="store_true")
        p.add_argument("--quiet", "-q", action="store_true")
        p.add_argument("--limit", type=int, default=30)
        p.add_argument("--output", "-o", default="")
        if name == "stream":
            p.add_argument("number", type=int)
            p.add_argument("--hex", action="store_true")
            p.add_argument("--max-bytes", type=int, default=4096)
            p.add_argument("--direction", choices=("both", "c2s", "s2c"), default="both")
        if name == "timeline":
            p.add_argument("--host", default="")
            p.add_argument("--kind", default="")
            p.add_argument("--severity", default="INFO")
        if name == "report":
            p.add_argument("--format", choices=sorted(reports.FORMATS), default="html")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        extra = adhoc_rule(args.pattern) if args.pattern else None
        spark = local_session()
        a = Analysis(spark, args.capture, max_packets=args.max_packets or None, rules_paths=tuple(args.rules), extra_rule=extra, dcs=tuple(args.dc))
        bad = a.meta.where("format = ''").select("file", F.array_join("notes", "; ").alias("why")).limit(5).collect()
        if bad:
            raise LookupError("; ".join(f"{r['file']}: {r['why']}" for r in bad))
        if a.meta.isEmpty():
            raise LookupError(f"{args.capture}: no such capture")
        COMMANDS[args.command](a, args)
        a.close()
    except (RuleError, LookupError, ValueError, AnalysisException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2
    except PySparkException as e:
        if "CaptureError" not in str(e):
            raise
        print("error: not a capture", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
