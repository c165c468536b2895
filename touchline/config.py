"""Settings of the pipeline in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    rating_start: float = 1500.0
    rating_k: float = 70.0
    carry_over: float = 0.5
    margin_min: float = -80.0
    margin_max: float = 80.0
    form_games: int = 5
    small_round: int = 5  #: games of a round up to which it counts as a representative round
    lump_levels: int = 40
    venue_levels: int = 42
    use_odds: bool = False
    edge: float = 1.05  #: a price must beat its threshold by this factor
    deviance_floor: float = 1e-9


SETTINGS = Settings()
