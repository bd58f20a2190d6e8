"""Settings, partly from the environment; values become literals of plans."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from ..functions import fixed

OFF = ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    min_match_score: float = fixed.MIN_SCORE
    soft_floor: float = fixed.SOFT_FLOOR
    max_serp_rows: int = fixed.MAX_SERP_ROWS
    max_text_chars: int = fixed.MAX_TEXT_CHARS
    price_gap: float = fixed.PRICE_GAP
    price_gap_enabled: bool = True
    title_verify: bool = True
    price_verify: bool = True
    settle_min_s: float = 3.0
    settle_max_s: float = 8.0

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """A bad number gives its default; the soft floor stays below the score; swapped bounds are put right."""
        env = os.environ if env is None else env

        def number(name: str, default: float) -> float:
            try:
                return float(env.get(name, "").strip() or default)
            except ValueError:
                return default

        on = lambda name: env.get(name, "true").strip().lower() not in OFF
        low, high = sorted((number("PAGE_SETTLE_MIN_S", cls.settle_min_s), number("PAGE_SETTLE_MAX_S", cls.settle_max_s)))
        return cls(
            soft_floor=min(number("MIN_MATCH_SCORE_SOFT_FLOOR", cls.soft_floor), 47.9),
            price_gap=number("PRICE_GAP_RESCRAPE_THRESHOLD", cls.price_gap),
            price_gap_enabled=on("PRICE_GAP_RESCRAPE"),
            title_verify=on("LLM_TITLE_VERIFY"),
            price_verify=on("LLM_PRICE_VERIFY"),
            settle_min_s=low,
            settle_max_s=high,
        )
