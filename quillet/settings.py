"""Settings and fixed values of the transcript pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

# Scenes with their target ratio and language.
SCENES: dict[str, tuple[float, str]] = {
    "daily_chat": (0.07, "zh"),
    "english_daily": (0.08, "en"),
    "vibe_coding": (0.12, "zh-en-mix"),
    "explanation": (0.12, "zh"),
    "meeting": (0.06, "zh"),
    "english_meeting": (0.05, "en"),
    "customer_service": (0.06, "zh"),
    "english_customer_service": (0.05, "en"),
    "academic": (0.04, "zh-en-mix"),
    "english_academic": (0.05, "en"),
    "navigation": (0.03, "zh"),
    "dictation_memo": (0.05, "zh-en-mix"),
    "english_dictation": (0.05, "en"),
    "voice_search": (0.03, "zh-en-mix"),
    "english_voice_search": (0.04, "en"),
    "english_tech": (0.10, "en"),
}
DEFAULT_RATIO = 0.05
SHORT_SCENES = ("vibe_coding", "academic", "dictation_memo", "voice_search", "passthrough")


@dataclass(frozen=True)
class Settings:
    total: int = 100_000
    round_size: int = 100
    seeds_per_scene: int = 3000
    seeds_per_round: int = 200
    passthrough_ratio: float = 0.08
    asr_ratio: float = 0.20
    dedup_threshold: float = 0.75
    drift: float = 0.05
    validation_ratio: float = 0.15
    shuffle_seed: int = 42
    concurrency: int = 20
    chunk_chars: int = 80
    window: int = 3
    memory_capacity: int = 128
    memory_ttl_ms: int = 1_200_000
    memory_promote_after: int = 2
    memory_min_confidence: float = 0.8
    soft_rotation_s: float = 30.0
    hard_rotation_s: float = 45.0
    ratios: dict[str, float] = field(default_factory=lambda: {k: v[0] for k, v in SCENES.items()})


SETTINGS = Settings()
