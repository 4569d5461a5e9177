"""Fixed parameters of the operators; every operator takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # They decide results and are the published defaults.
    hot_percent: int = 10
    warm_percent: int = 40
    cold_ttl_days: float = 30
    dedup_hard: float = 0.85
    dedup_soft: float = 0.75
    merge_field_tokens: int = 8192
    l0_tokens: int = 64
    l1_tokens: int = 256
    consolidate_most: int = 50
    memory_search_limit: int = 10
    skill_search_limit: int = 5
    decay_alpha: float = 0.05
    decay_weight: float = 0.1
    extract_window_tokens: int = 65536
    memory_score: float = 0.7
    sft_score: float = 0.8
    sft_trigger: int = 100
    cluster_similarity: float = 0.75
    crystallize_members: int = 5
    recrystallize_delta: int = 3
    evolution_batch: int = 10
    linked_boost: float = 1.15
    tag_cap: int = 10
    file_cap_bytes: int = 10_000_000
    tier_boost: dict = field(default_factory=lambda: {"hot": 1.2, "warm": 1.0, "cold": 0.8})


DEFAULTS = Settings()
