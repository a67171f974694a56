"""What is kept of traffic at most."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    """Each limit may be None, which keeps all. What a limit leaves out is told: bytes of a stream in its left_out, of HTTP messages
    in their note, and all of it in Analysis.left_out."""

    # What the sources of this behaviour keep.
    stream_bytes: int | None = 64 << 20
    messages: int | None = 512
    body: int | None = 16 << 20
    inflated: int | None = 32 << 20
    request_body: int | None = 256 << 10
    lines: int | None = 2000
    basic_lines: int | None = 400
    scan_window: int | None = 2 << 20
    observations: int | None = 20_000
    carve: int | None = 1 << 30
    # Own values: longer heads and lines are none.
    head: int | None = 1 << 20
    line: int | None = 1 << 20

    @staticmethod
    def none() -> Limits:
        return Limits(**{f.name: None for f in fields(Limits)})
