"""Operating limits, passed to the operators as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """The limits and timers of the conversion service."""

    max_upload_bytes: int = 50 * 1024 * 1024
    max_batch_files: int = 10
    text_probe_bytes: int = 512
    scan_retries: int = 2
    scan_backoff_s: int = 3
    reconnect_cap_s: int = 30
    barrier_timeout_s: int = 300
    heartbeat_s: int = 15
    heartbeat_range_s: tuple[int, int] = (5, 60)
    retention_s: int = 600

    @property
    def state_ttl_s(self) -> int:
        return self.retention_s + 60


DEFAULT = Limits()
