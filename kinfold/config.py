"""Settings of an entity-resolution run."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    seed: int = 42
    blocking_top_k: int = 50
    max_key_freq: int = 2000  #: one cap for training and for scoring
    prefix_keys: bool = False
    dedupe_keys: bool = False
    train_sample_size: int = 15_000
    tune_ratio: float = 0.2  #: share of the sample that the threshold is chosen on
    test_ratio: float = 0.2  #: share that is only reported on
    model_rounds: int = 300
    model_depth: int = 6
    step_size: float = 0.05
    subsample: float = 0.8
    feature_share: str = "0.8"
    threshold_grid: tuple[float, ...] = tuple(round(0.20 + 0.05 * i, 2) for i in range(13))
    default_threshold: float = 0.55
    ablation_grid: tuple[float, ...] = field(default=(0.30, 0.40, 0.50, 0.55, 0.60, 0.70))

    def digest(self) -> str:
        """Names tables made with these settings."""
        return hashlib.md5(repr(self).encode()).hexdigest()[:12]
