"""One configuration for the whole engine; the values are the defaults users of such a server expect."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Windows (minutes) and line counts that the user interface offers.
UI_WINDOWS_MINUTES = (5, 60, 180, 1440)
UI_COUNTS = (10, 30, 50, 100)


def exponential_ranges(base_ms: int = 20_000, steps: int = 10, factor: int = 3) -> tuple[int, ...]:
    """Block ranges: base, base * factor, ..."""
    return tuple(base_ms * factor**k for k in range(steps))


@dataclass(frozen=True)
class EngineConfig:
    """block_ms: span of a head, and the trigger of continuous ingest; flush_bytes: input that a block is cut at at the
    latest; promoted: labels that the store keeps as columns of their own, so that their filters reach the scan."""

    block_ms: int = 20_000
    flush_bytes: int = 1 << 30
    promoted: tuple[str, ...] = ()
    retention_ms: int = 12 * 3_600_000
    ranges_ms: tuple[int, ...] = field(default_factory=exponential_ranges)
    max_records_per_file: int = 5_000_000
