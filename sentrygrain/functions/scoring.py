"""Scalar formulae of profiles, risk and severity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SEVERITIES, SEVERITY_UPPER


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def rarity(count: Column, n_events: Column, n_keys: Column, smoothing: float) -> Column:
    """Smoothed surprise of a value seen ``count`` times among ``n_events``."""
    return -F.ln((count + smoothing) / (n_events + smoothing * (n_keys + 1)))


def zscore(value: Column, mean: Column, std: Column, floor: float) -> Column:
    return (value - mean) / F.greatest(std, F.lit(floor))


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def ramp(value: Column, low: float | Column, high: float | Column) -> Column:
    """0 below ``low``, 1 above ``high``, linear between; a step if degenerate."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    step = F.when(value > low, 1.0).otherwise(0.0)
    return F.when(high <= low, step).otherwise(clamp(F.try_divide(value - low, high - low)))


def decay(elapsed: Column, half_life: float) -> Column:
    """Fraction left after ``elapsed``, in the unit of ``half_life``."""
    if half_life <= 0:
        return F.lit(0.0)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), elapsed) / half_life)


def saturating_risk(evidence: Column, scale: float) -> Column:
    return 100.0 * (1.0 - F.exp(-F.greatest(evidence, F.lit(0.0)) / scale))


def evidence_for_risk(risk: Column, scale: float) -> Column:
    """Inverse of :func:`saturating_risk`."""
    bounded = F.least(F.lit(99.999999), F.greatest(F.lit(0.0), risk))
    return -scale * F.ln(1.0 - bounded / 100.0)


def severity(score: Column) -> Column:
    """Lowest band whose upper bound is not exceeded."""
    banded = F.lit(SEVERITIES[-1])
    for name in reversed(SEVERITIES[:-1]):
        banded = F.when(score <= SEVERITY_UPPER[name], name).otherwise(banded)
    return banded


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name).cast("int")


def profile_confidence(n: Column, minimum: int, maturity: int) -> Column:
    """How far a profile with ``n`` events can be trusted, in [0, 1]."""
    blending = 0.3 + 0.7 * (n - minimum) / max(maturity - minimum, 1)
    cold = F.least(F.lit(0.3), n / max(minimum, 1) * 0.3)
    return F.when(n < minimum, cold).when(n < maturity, F.least(F.lit(1.0), blending)).otherwise(1.0)


def profile_stage(n: Column, minimum: int, maturity: int) -> Column:
    return F.when(n < minimum, "cold-start").when(n < maturity, "blending").otherwise("mature")
