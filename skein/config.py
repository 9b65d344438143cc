"""Knobs of the engine with their shipped values, and the stamp that a set of knobs leaves on its results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class DedupConfig:
    shingle: int = 5
    min_shingles: int = 20
    jaccard: float = 0.85
    permutations: int = 128
    bands: int = 16
    rows: int = 8


@dataclass(frozen=True)
class CompareConfig:
    vector_weight: float = 0.45
    skill_weight: float = 0.45
    seniority_weight: float = 0.10
    edge: float = 0.5
    neighbours: int = 25
    role_edge: float = 0.75
    band_gap: int = 1
    unknown: float = 0.7
    span_years: float = 10.0
    drift_minor: float = 0.25
    drift_major: float = 0.5
    drift_years: float = 2.0
    max_cluster: int = 50


@dataclass(frozen=True)
class MergeConfig:
    jaccard: float = 0.7
    max_statements: int = 12
    core_share: float = 0.5


@dataclass(frozen=True)
class ScoreConfig:
    high: float = 20.0
    medium: float = 10.0
    low: float = 5.0
    info: float = 0.0
    decay: float = 0.7
    bands: tuple[tuple[float, str], ...] = ((90.0, "A"), (75.0, "B"), (60.0, "C"), (40.0, "D"))
    fallback: str = "F"


def stamp(config) -> str:
    """Twelve hex digits of the knobs, in an order that doesn't depend on how they were written."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:12]
