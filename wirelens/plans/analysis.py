"""One capture's analysis as lazy DataFrames: what isn't asked for is never planned."""

from __future__ import annotations

import contextlib
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import app, covert, detectors, dns, extract, findings, flows, streams
from ..operators.limits import Limits
from ..sources.pcap import capture_meta, read_packets
from ..session import remove, shared_folder
from ..sources.rules import Rule, load_rules


#: Tables that are written, and detectors that are planned, at the same time.
SIDE_BY_SIDE = 6


class Analysis:
    """Packets of a path (or given) and all that follows from them. Packets, flows, messages and the like, which many results
    read, are written to a table in the shared folder when they are first asked for: plans start from it and stay short, and a
    lost executor takes nothing along. close(), or the end of a with block, removes them. limits says what is kept of traffic."""

    def __init__(
        self, spark: SparkSession, path: str = "", *, packets: DataFrame | None = None, max_packets: int | None = None, rules_paths: tuple[str, ...] = (), extra_rule: Rule | None = None, dcs: tuple[str, ...] = (), limits: Limits = Limits()
    ) -> None:
        self.spark, self.path, self.max_packets, self.extra_rule, self.dcs, self.limits = spark, path, max_packets, extra_rule, dcs, limits
        self.rules = load_rules(rules_paths)
        self._given, self._kept, self._began = packets, [], time.monotonic()

    def metrics(self) -> DataFrame:
        """Packets, seconds since the analysis began and packets a second: to be asked for when the work is done."""
        n, seconds = self.packets.count(), time.monotonic() - self._began
        return self.spark.createDataFrame([(n, seconds, n / seconds)], "packets long, seconds double, packets_per_second double")

    def _keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{uuid.uuid4().hex}"
        self._kept.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def _folder(self) -> str:
        return shared_folder(self.spark, "analysis")

    def close(self) -> None:
        if self._kept:
            remove(self.spark, self._folder)
        if "chunks" in self.__dict__:
            self.chunks.unpersist()
        self._kept = []

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def packets(self) -> DataFrame:
        return self._keep(self._given if self._given is not None else read_packets(self.spark, self.path, self.max_packets))

    @cached_property
    def meta(self) -> DataFrame:
        seen = self.packets.groupBy("file").agg(F.count(F.lit(1)).alias("packets"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        joined = capture_meta(self.spark, self.path, self.max_packets).join(seen, "file", "left")
        return self._keep(joined.withColumn("duration", F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0.0))))

    @cached_property
    def flows(self) -> DataFrame:
        return self._keep(flows.flows(self.packets))

    @cached_property
    def conversations(self) -> DataFrame:
        return self._keep(flows.conversations(self.packets))

    @cached_property
    def dns(self) -> DataFrame:
        return self.packets.where("dns IS NOT NULL").select("file", "frame", "ts", "dns.*")

    @cached_property
    def dns_named(self) -> DataFrame:
        return self._keep(dns.with_domain(self.dns))

    @cached_property
    def hosts(self) -> DataFrame:
        return self._keep(flows.learn_hostnames(flows.hosts(self.packets, with_v6=True), self.dns))

    @cached_property
    def chunks(self) -> DataFrame:
        """The streams' bytes in pieces, which all parsers read. Their order by partition is what parsers rely on, which a written
        table would lose; what an executor loses is made again from the packets."""
        return streams.stream_chunks(self.packets, self.limits).persist(StorageLevel.DISK_ONLY)

    @cached_property
    def stream_table(self) -> DataFrame:
        """The streams without their bytes."""
        return streams.stream_table(self.packets)

    @cached_property
    def streams(self) -> DataFrame:
        """The streams with each side's bytes as one value."""
        return streams.assembled(self.chunks)

    @cached_property
    def http(self) -> DataFrame:
        return self._keep(app.http_transactions(self.chunks, self.limits))

    @cached_property
    def tls(self) -> DataFrame:
        return self._keep(app.tls_sessions(self.chunks))

    @cached_property
    def dialog(self) -> DataFrame:
        return self._keep(app.dialog(self.chunks, self.limits))

    @cached_property
    def credentials(self) -> DataFrame:
        return self._keep(app.credentials(self.dialog, self.limits))

    @cached_property
    def banners(self) -> DataFrame:
        return app.banners(self.dialog)

    @cached_property
    def icmp(self) -> DataFrame:
        return app.icmp(self.packets)

    @cached_property
    def arp(self) -> DataFrame:
        return app.arp_events(self.packets)

    @cached_property
    def dhcp(self) -> DataFrame:
        return app.dhcp(self.packets)

    @cached_property
    def surfaces(self) -> DataFrame:
        return extract.surfaces(self.chunks, self.http, self.dns, self.icmp, self.limits.scan_window)

    @cached_property
    def secrets(self) -> DataFrame:
        return self._keep(extract.secrets(self.surfaces, self.rules, self.extra_rule)).orderBy("kind", F.col("confidence") != "high", "value")

    @cached_property
    def artifacts(self) -> DataFrame:
        return extract.carved(extract.http_artifacts(self.http).unionByName(extract.smtp_artifacts(self.chunks)), self.limits.carve)

    @cached_property
    def covert_fields(self) -> DataFrame:
        return self._keep(covert.observations(self))

    @cached_property
    def covert(self) -> DataFrame:
        return self._keep(covert.candidates(self.covert_fields)).orderBy(F.col("printable").desc(), *covert.KEY)

    @cached_property
    def domain_controllers(self) -> DataFrame:
        extra = self.spark.createDataFrame([(ip,) for ip in self.dcs], "dc string") if self.dcs else None
        return detectors.domain_controllers(self.flows, self.dns, extra)

    @cached_property
    def findings(self) -> DataFrame:
        """All detectors, ranked; a detector that fails gives a finding that says so.

        They run together, as one plan whose parts share packets, flows and messages. Only if that fails, each runs on its own, so
        that the failure is that detector's alone.
        """

        def failed(name: str, e: Exception) -> DataFrame:
            first = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
            made = findings.finding(self.spark.range(1), id=F.lit(f"internal.detector-error.{name}"), title=f"The detector {name} failed", severity="INFO", confidence="low", description=first, explanation="Other results are complete.", verification="", protocol="")
            return findings.conform(made)

        def planned(item: tuple) -> DataFrame:
            name, detect = item
            try:
                return findings.conform(detect(self))
            except Exception as e:  # any detector, users' too
                return failed(name, e)

        self._prepare()
        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            found = dict(zip(detectors.DETECTORS, pool.map(planned, detectors.DETECTORS.items())))
        try:
            every = self._keep(reduce(DataFrame.unionByName, found.values()))
        except Exception:
            parts = []
            for name, df in found.items():
                try:
                    parts.append(self._keep(df))
                except Exception as e:
                    parts.append(failed(name, e))
            every = reduce(DataFrame.unionByName, parts)
        return findings.ranked(every)

    def _prepare(self) -> None:
        """Write the tables that detectors share, those that don't need each other side by side. What fails here fails again in the
        detectors that ask for it."""
        _ = self.packets, self._folder
        with contextlib.suppress(Exception), ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            _ = self.chunks
            for group in (("flows", "conversations", "dns_named", "http", "dialog"), ("credentials", "secrets", "covert_fields"), ("covert",)):
                list(pool.map(lambda name: getattr(self, name), group))

    @cached_property
    def left_out(self) -> DataFrame:
        """What the limits left out: file, stream, what."""
        bytes_ = self.chunks.groupBy("file", F.col("index").alias("stream")).agg(F.sum("left_out").alias("n")).where("n > 0")
        of_streams = bytes_.select("file", "stream", F.format_string("%d bytes of the stream are left out", "n").alias("what"))
        of_http = self.http.where("note LIKE '%left out%' OR note LIKE '%is cut%'").select("file", "stream", F.col("note").alias("what"))
        files = self.artifacts.where("skipped").select("file", "stream", F.format_string("the file %s is not carved", "name").alias("what"))
        return of_streams.unionByName(of_http).unionByName(files)

    @cached_property
    def risk(self) -> DataFrame:
        return findings.risk_score(self.findings)

    @cached_property
    def timeline(self) -> DataFrame:
        none = F.lit("INFO").alias("severity")
        parts = {
            "dns": self.dns.where("NOT is_response").select("ts", F.col("client").alias("host"), none, F.concat_ws(" ", F.lit("lookup"), "qtype", "name").alias("text")),
            "http": self.http.select("ts", F.col("client").alias("host"), none, F.concat_ws(" ", "method", F.concat("host", "url"), F.col("status").cast("string")).alias("text")),
            "stream": self.stream_table.select(F.col("start_ts").alias("ts"), F.col("client").alias("host"), none, F.format_string("stream %d to %s:%d", "index", "server", "server_port").alias("text")),
            "credential": self.credentials.select("ts", F.col("client").alias("host"), F.lit("HIGH").alias("severity"), F.concat_ws(" ", "protocol", F.lit("login as"), "username").alias("text")),
            "finding": self.findings.where("first_ts IS NOT NULL").select(F.col("first_ts").alias("ts"), F.coalesce(F.get("hosts", F.lit(0)), F.lit("")).alias("host"), "severity", F.col("title").alias("text")),
        }
        return self._keep(findings.timeline(parts)).orderBy("ts", "kind", "text")  # a written table has no order
