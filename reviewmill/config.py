"""Knobs that shape results. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

OTHER = "other"
OTHER_LABEL = "Unclassified"
PLAY_STORE = "play_store"
ROLLUP_NOTE = "4-week rollup (low weekly volume)"

# Default theme seeds, in seed order.
DEFAULT_SEEDS = (
    ("onboarding", "Onboarding & demat"),
    ("kyc", "KYC & verification"),
    ("payments", "Payments & UPI"),
    ("trading", "Trading & orders"),
    ("withdrawals", "Withdrawals & payouts"),
)


@dataclass(frozen=True)
class WindowConfig:
    corpus_weeks: int = 4
    reporting_days: int = 7
    min_week_reviews: int = 15
    fallback_days: int = 28


@dataclass(frozen=True)
class ThemeConfig:
    seeds: tuple[tuple[str, str], ...] = DEFAULT_SEEDS
    max_total: int = 5
    highlight: int = 3
    split_share: float = 0.20
    split_sample: int = 50

    @property
    def seed_ids(self) -> list[str]:
        return [seed_id for seed_id, _ in self.seeds]


@dataclass(frozen=True)
class NoteConfig:
    max_words: int = 250
    quote_count: int = 3
    action_count: int = 3
    quote_min_chars: int = 40
    quote_max_chars: int = 200
    similarity: float = 0.8
    max_candidates: int = 8


@dataclass(frozen=True)
class LimitConfig:
    min_review_words: int = 8
    batch_size: int = 10
    payload_chars: int = 120
    generate_attempts: int = 3


@dataclass(frozen=True)
class Config:
    windows: WindowConfig = field(default_factory=WindowConfig)
    themes: ThemeConfig = field(default_factory=ThemeConfig)
    note: NoteConfig = field(default_factory=NoteConfig)
    limits: LimitConfig = field(default_factory=LimitConfig)


DEFAULT = Config()
