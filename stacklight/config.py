"""Defaults of the query and build parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Defaults that results depend on.
    reference_year: int = 2024
    min_description_words: int = 25
    dedup_threshold: float = 0.92
    initial_top_k: int = 50
    final_top_k: int = 16
    san_seed_count: int = 5
    san_top_k: int = 16
    san_min_activation: float = 0.1
    san_retention: float = 0.6
    san_decay: float = 0.05
    san_suppress: float = 0.01
    san_iterations: int = 10
    san_initial_energy: float = 100.0
    category_min_count: int = 50
    evaluation_rows: int = 300
    extraction_attempts: int = 3
    prompt_chars: int = 2000


DEFAULTS = Config()
