"""Fixed values of the index: thresholds, versions, sizes. Parameters of the operators default to these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    score_version: str = "rule-v1"
    calc_version: str = "netscore-v1"
    bull_threshold: float = 60.0  # market score
    bear_threshold: float = 40.0
    alert_delta: float = 15.0
    bull_cutoff: float = 0.25  # direction, strict
    bear_cutoff: float = -0.25
    low_confidence: float = 0.6
    bear_weight: float = 1.0
    min_macro_len: int = 30
    min_preamble_len: int = 60
    max_body_products: int = 3
    max_advice_len: int = 120
    max_title_tail: int = 24
    negation_magnitude: float = 0.5
    negation_confidence: float = 0.55
    max_abs_direction: float = 2.0
    min_scaled_abs: float = 0.3
    fallback_tail_chars: int = 120
    negation_window: int = 6
    max_garbled_ratio: float = 0.10
    backfill_clock: str = "06:30:00"
    intraday_clock: str = "12:30:00"
    strong_cutoff: float = 1.5  # display
    max_matrix_orgs: int = 8
    max_matrix_rows: int = 20


DEFAULT = Settings()
INTRADAY_HINTS = ("午间", "午评", "午后", "盘中", "更新", "日中")
INBOX_SUFFIXES = (".txt", ".md", ".markdown", ".html", ".htm", ".pdf")
CHANNELS = ("inbox", "website", "email")
UNKNOWN_ORG = "未知机构"
