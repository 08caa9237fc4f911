"""Settings of a store and its front."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Knobs of ingest, storage, compaction and retention; None switches one off.

    storage "memory" keeps a store in a folder of its own that begins empty, with its
    spans cached. Intervals are those of Engine.start()."""

    storage: str = "disk"  # disk or memory
    data_dir: str = "spanloom_data"
    buffer_shards: int = 4
    flush_interval_s: float = 1.0
    max_buffer_spans: int = 1000
    query_timeout_s: float | None = 30.0
    compaction_threshold: int = 500
    compaction_max_raw_age_s: int = 60
    compaction_interval_s: float = 30.0
    compaction_backoff_cap_s: float = 300.0
    compression: str = "zstd"
    compression_level: int = 6
    merge_target: int = 2000
    merge_min_blocks: int = 4
    retention_max_age_s: int | None = 7 * 86_400
    retention_max_bytes: int | None = None
    retention_max_terms: int | None = None
    retention_interval_s: float = 120.0
    vacuum_after_s: float = 3600.0
    http_port: int = 10428
    bearer_token: str | None = None
    max_body_bytes: int = 10_000_000
