"""Options with their defaults, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Admission:
    global_domain_cap: int = 50000
    #: One URL counts once for all jobs, as existence checks by URL do; otherwise once for each job.
    url_across_jobs: bool = True
    existence_by_url: bool = False
    priority: int = 1


@dataclass(frozen=True)
class Politeness:
    default_delay_ms: int = 250
    max_delay_ms: int = 5000
    robots_ttl_secs: int = 86400
    missing_ttl_secs: int = 3600


@dataclass(frozen=True)
class Media:
    audio_cap_bytes: int = 500 * 1024 * 1024
    min_free_bytes: int = 5 * 1024**3
    max_total_bytes: int = 0
    min_duration_secs: int = 30
    max_duration_secs: int = 1800
    min_bitrate_kbps: int = 96
