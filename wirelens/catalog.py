"""Every registered query, and the DuckDB SQL it is compared with."""

from __future__ import annotations

from . import queries_capture, queries_net, queries_text  # noqa: F401

QUERIES: dict = {**queries_net.QUERIES}
ORACLE_SQL: dict = {**queries_net.ORACLE_SQL}
