"""Column builders over vectors, counts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import CompareConfig, ScoreConfig


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.0), F.log(n / (1.0 + df)))


def decayed_penalty(count: Column, base: float, decay: float) -> Column:
    """``base`` for the first finding and ``decay`` times the last for each further one, summed in closed form."""
    return count * base if decay >= 1 else base * (1 - F.pow(F.lit(decay), count)) / (1 - decay)


def score(high: Column, medium: Column, low: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    lost = decayed_penalty(high, cfg.high, cfg.decay) + decayed_penalty(medium, cfg.medium, cfg.decay) + decayed_penalty(low, cfg.low, cfg.decay)
    return F.greatest(F.lit(0.0), 100.0 - lost)


def grade(s: Column, cfg: ScoreConfig = ScoreConfig()) -> Column:
    out = None
    for least, name in cfg.bands:
        out = F.when(s >= least, name) if out is None else out.when(s >= least, name)
    return out.otherwise(cfg.fallback)


def closeness(a: Column, b: Column, cfg: CompareConfig = CompareConfig()) -> Column:
    """Closeness of two amounts that falls to 0 over the span; unknown if either is."""
    return F.when(a.isNull() | b.isNull(), cfg.unknown).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / cfg.span_years))


def blended(vector: Column, skill: Column, seniority: Column, cfg: CompareConfig = CompareConfig()) -> Column:
    return F.round(clamped(cfg.vector_weight * vector + cfg.skill_weight * skill + cfg.seniority_weight * seniority), 4)


def drift_level(distance: Column, escalated: Column, cfg: CompareConfig = CompareConfig()) -> Column:
    return F.when((distance >= cfg.drift_major) | escalated, "major").when(distance >= cfg.drift_minor, "minor").otherwise("aligned")


def histogram_bin(x: Column, width: float, bins: int) -> Column:
    """The bin of a value, the last one closed, values outside clamped."""
    return F.greatest(F.lit(0), F.least(F.floor(x / width), F.lit(bins - 1))).cast("int")


def nearest_rank(sorted_values: Column, p: int) -> Column:
    """The value at place n*p/100 (cut to a whole number, at most n-1); 0 without values."""
    n = F.size(sorted_values)
    return F.coalesce(F.get(sorted_values, F.least(n - 1, F.floor(n * p / 100).cast("int"))), F.lit(0.0))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part/whole, 0 where there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, digits))
