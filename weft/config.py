"""Thresholds, tokens and sizes of the click-stream engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    missing_token: str = "NOT AVAILABLE"
    genre_separator: str = ", "
    #: Seconds: a click of at least this length is followed through; Short up to the first, Medium up to the second.
    follow_through: float = 600.0
    short_click: float = 600.0
    medium_click: float = 3600.0
    #: Films up to this year are old.
    old_year: int = 2010
    #: Bounds of the medium follow-through class, both inclusive.
    medium_from: float = 0.3
    medium_to: float = 0.6
    titles_per_user: int = 10
    similar_users: int = 2
    recommendations: int = 5
    hashes: int = 100
    bands: int = 20
    prime: int = 29
    hash_seed: int = 1

    @property
    def rows_per_band(self) -> int:
        return self.hashes // self.bands


DEFAULT = Config()
