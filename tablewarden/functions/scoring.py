"""Severity bands, weights and small lookups as expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden import config


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """CASE over a fixed table of a few entries."""
    out = None
    for k, v in table.items():
        value = F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out if default is None else out.otherwise(default)


def severity(share: Column) -> Column:
    return (F.when(share >= config.SEVERITY_HIGH_FROM, "high")
            .when(share >= config.SEVERITY_MEDIUM_FROM, "medium").otherwise("low"))


def psi_severity(psi: Column) -> Column:
    return (F.when(psi < config.PSI_AMBER, "low")
            .when(psi < config.PSI_RED, "medium").otherwise("high"))


def ks_severity(p_value: Column) -> Column:
    return (F.when(p_value >= config.KS_ALPHA, "low")
            .when(p_value >= config.KS_HIGH_BELOW, "medium").otherwise("high"))


def severity_rank(level: Column) -> Column:
    return F.when(level == "high", 2).when(level == "medium", 1).otherwise(0)


def confidence(a: Column, b: Column) -> Column:
    """Agreement of two counts: 1 when equal and above zero."""
    return F.round(F.least(a, b) / F.greatest(a, b, F.lit(1)), 4)


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Two-sided p-value from the Kolmogorov series, clipped to [0, 1]."""
    lam2 = (n * m / (n + m)) * d * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam2))
    # Below this the alternating series has not converged; the true value is 1 to 12 digits.
    return F.when(lam2 < 0.03, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def direction(reference_mean: Column, current_mean: Column) -> Column:
    ratio = F.try_divide(current_mean, reference_mean)
    return (F.when(reference_mean.isNull() | current_mean.isNull(), "unknown")
            .when(F.abs(reference_mean) < 1e-9, "shift")
            .when(ratio > 1.1, "increase").when(ratio < 0.9, "decrease").otherwise("shift"))
