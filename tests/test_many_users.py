"""Queries over more users and events than addresses and sequence numbers have room for."""

import duckdb
import pytest

from wirelens import catalog

USERS = (3, 63_999, 64_000, 89_999, 16_383_999, 16_384_003, 40_000_007)


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Users beyond 10.0.255.x, and beyond the blocks that three octets count; events whose sequence number is over 32 bits."""
    folder = tmp_path_factory.mktemp("users")
    users = ", ".join(map(str, USERS))
    duckdb.sql(f"""COPY (SELECT k + b AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, u AS user_id, ['click', 'error', 'purchase', 'signup', 'view'][1 + (k // 7) % 5] AS event_type,
    (k % 700)::DOUBLE AS value, '{{}}' AS props FROM range(700) r(k), unnest([{users}]) v(u), (VALUES (0), (4294600), (9000000)) w(b) WHERE k % {len(USERS)} = list_position([{users}], u) - 1)
    TO '{folder}/events.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", ["bulk_transfer", "host_overview", "network_classes", "detect_icmp_payload", "packet_dissect"])
def test_many_users(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet'")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(map(repr, found.fetchall()))
    rows = catalog.QUERIES[name](spark, events).select(*names).collect()
    assert want and sorted(repr(tuple(r)) for r in rows) == want
