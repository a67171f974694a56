"""Joins by time and mergeable states against brute force."""

import random
from collections import Counter

import frames as fr
import pytest
from pyspark.sql import functions as F

from wirelens.operators import sketches, temporal
from wirelens.plans.analysis import Analysis


@pytest.mark.parametrize("seconds", [0.7, 5.0, 1e6])
def test_as_of(spark, seconds):
    rng = random.Random(3)
    times = lambda: rng.choice([None, float(rng.randrange(12)), rng.random() * 20 - 5])
    rows = [(k, rng.choice(["a", "a", "b", None, "never"]), times()) for k in range(200)] + [(7, "a", 3.0)] * 2
    facts = [(rng.choice(["a", "b", None]), times(), rng.choice(["x", "y", "z", None])) for _ in range(40)]
    left = spark.createDataFrame(rows, "id int, who string, t double").repartition(5)
    got = Counter((r.id, r.fact) for r in temporal.as_of(left, spark.createDataFrame(facts, "who string, t double, fact string"), "who", "t", "fact", seconds).collect())

    def last(who, t):
        found = [(ft, f) for w, ft, f in facts if who is not None and t is not None and w == who and ft is not None and f is not None and ft <= t]
        return max(found)[1] if found else None

    assert got == Counter((k, last(who, t)) for k, who, t in rows) and len({f for _, f in got}) == 4


def test_as_of_spreads_a_hot_key(spark):
    rows = spark.range(5000).select(F.lit("hot").alias("who"), F.col("id").cast("double").alias("t"), "id")
    facts = rows.where("id % 100 = 0").select("who", "t", F.col("id").alias("fact"))
    found = temporal.as_of(rows, facts, "who", "t", "fact", 50.0)
    assert found.where("fact <> id - id % 100 OR fact IS NULL").isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(who" in plan and "__bucket" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seconds", [0.5, 3.0, 1000.0])
def test_during(spark, seconds):
    rng = random.Random(5)
    rows = [(k, rng.choice("ab"), rng.choice([None, float(rng.randrange(20)), rng.random() * 20])) for k in range(100)]
    windows = [(k, rng.choice("ab"), a, a if a is None else a + rng.choice([-1, 0, 0.5, 7])) for k in range(40) for a in [rng.choice([None, float(rng.randrange(20)), rng.random() * 20])]]
    left, right = spark.createDataFrame(rows, "row int, host string, t double"), spark.createDataFrame(windows, "win int, host string, a double, b double")
    got = sorted((r.row, r.win) for r in temporal.during(left, right, "t", "a", "b", seconds, ["host"]).select("row", "win").collect())
    assert got == sorted((r, w) for r, h, t in rows for w, g, a, b in windows if h == g and t is not None and a is not None and a <= t <= b)
    plan = temporal.during(left, right.drop("host"), "t", "a", "b", seconds)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_owners_change_over_time(spark, tmp_path):
    frames = [(fr.BASE, fr.arp(2, fr.MAC_C, "10.0.0.9", "10.0.0.1")), (fr.BASE + 5, fr.udp("10.0.0.9", 1, "10.0.0.1", 2, b"a")), (fr.BASE + 4000, fr.arp(2, fr.MAC_S, "10.0.0.9", "10.0.0.1")), (fr.BASE + 9000, fr.udp("10.0.0.9", 1, "10.0.0.1", 2, b"b"))]
    (tmp_path / "o.pcap").write_bytes(fr.pcap(frames))
    a = Analysis(spark, str(tmp_path / "o.pcap"))
    found = {r.frame: r.owner for r in temporal.owned(a.packets, temporal.owners(a.dhcp, a.arp, a.dns)).where("proto = 'udp'").collect()}
    assert found == {2: "arp 08:00:27:11:11:11", 4: "arp 08:00:27:22:22:22"}
    spans = spark.createDataFrame([("f", ["10.0.0.9"], fr.BASE + 1, fr.BASE + 4000), ("g", ["10.0.0.1"], fr.BASE + 9000, None), ("h", ["1.1.1.1"], fr.BASE, fr.BASE + 1e6)], "id string, hosts array<string>, first_ts double, last_ts double")
    assert sorted((r.id, r.frame) for r in temporal.finding_packets(spans, a.packets).collect()) == [("f", 2), ("f", 3), ("g", 4)]
    a.close()


def test_states_merge_and_are_within_bounds(spark):
    """Of parts and of the whole; one key has a third of the rows."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), (F.col("id") % 5).alias("day"), (F.xxhash64("id") % 4000).alias("peer"),
        F.when(F.col("id") % 4 == 0, "often").when(F.col("id") % 10 == 1, "second").otherwise(F.concat(F.lit("v"), (F.col("id") % 500).cast("string"))).alias("value"), (F.col("id") % 1000).cast("double").alias("gap"),
    )
    of = dict(distinct={"peers": F.col("peer")}, frequent={"top": F.col("value")}, spread={"gaps": F.col("gap")})
    names = dict(distinct=["peers"], frequent=["top"], spread=["gaps"])
    merged = sketches.merged(sketches.sketch(rows, ["key", "day"], **of), ["key"], **names)
    got = {r.key: r for r in sketches.estimates(merged, **names, top=3, ranks=(0.0, 0.5, 0.9, 1.0)).collect()}
    whole = {r.key: r for r in sketches.estimates(sketches.sketch(rows, ["key"], **of), **names, top=3, ranks=(0.0, 0.5, 0.9, 1.0)).collect()}
    exact = {r.key: r for r in rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("peer").alias("peers"), F.count_if(F.col("value") == "often").alias("often"), F.sort_array(F.collect_list("gap")).alias("gaps")).collect()}
    assert set(got) == set(exact)
    for key, want in exact.items():
        for r in (got[key], whole[key]):
            assert r.n == want.n and abs(r.peers - want.peers) <= 0.04 * want.peers
            assert (r.top[0].item, r.top[0]["count"]) == ("often", want.often)
            for rank, value in zip((0.0, 0.5, 0.9, 1.0), r.gaps):
                below = sum(g <= value for g in want.gaps) / want.n
                assert abs(below - rank) <= 0.03
    assert got["hot"].peers == whole["hot"].peers  # the union of distinct counts is exact in its state
    empty = sketches.sketch(rows.where("false"), ["key"], **of)
    assert sketches.estimates(sketches.merged(empty, ["key"], **names), **names).count() == 0
