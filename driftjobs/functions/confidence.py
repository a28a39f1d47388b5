"""Maturity, confidence, severity and alert decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftjobs import constants as C


def _steps(x: Column, steps, otherwise, met=lambda x, limit: x >= limit) -> Column:
    """The value of the first step that x meets."""
    out = None
    for limit, value in steps:
        out = F.when(met(x, limit), value) if out is None else out.when(met(x, limit), value)
    return out.otherwise(otherwise)


def _by_name(name: Column, values: dict, otherwise) -> Column:
    return _steps(name, values.items(), otherwise, lambda x, k: x == k)


def maturity_state(total: Column, daily_rate: Column | float = 0.0) -> Column:
    rate = F.lit(daily_rate) if isinstance(daily_rate, (int, float)) else daily_rate
    by_count = _steps(total, C.MATURITY_UP_TO, C.MATURE, lambda x, k: x <= k)
    return F.when((rate > 0) & (rate < C.SPARSE_DAILY_RATE), C.SPARSE).otherwise(by_count)


def window_days(maturity: Column) -> Column:
    return _by_name(maturity, C.WINDOW_DAYS, C.WINDOW_DAYS[C.MATURE])


def maturity_score(maturity: Column) -> Column:
    return _by_name(maturity, C.MATURITY_SCORE, 0.1)


def sample_score(n: Column) -> Column:
    return _steps(n, C.SAMPLE_SCORE, 0.05)


def freshness_score(age_hours: Column, days: Column) -> Column:
    ratio = age_hours / F.when(days > 0, days * 24.0)
    return F.when(ratio.isNull(), 0.1).otherwise(_steps(ratio, C.FRESHNESS_SCORE, 0.1, lambda x, k: x <= k))


def deployment_score(hours: Column) -> Column:
    return F.when(hours.isNull(), 1.0).otherwise(_steps(hours, C.DEPLOY_SCORE, 1.0, lambda x, k: x < k))


def confidence_level(composite: Column) -> Column:
    return _steps(composite, C.CONFIDENCE_LEVELS, "low")


def confidence(maturity: Column, samples: Column, age_hours: Column, days: Column, deploy_hours: Column, persistence: Column) -> Column:
    """A struct of score, level and factors; the level is that of the score before rounding."""
    factors = (maturity_score(maturity), sample_score(samples), freshness_score(age_hours, days), deployment_score(deploy_hours))
    weights = [_by_name(maturity, {k: w[i] for k, w in C.CONFIDENCE_WEIGHTS.items()}, C.CONFIDENCE_WEIGHTS[C.MATURE][i]) for i in range(4)]
    plain = sum((f * w for f, w in zip(factors[1:], weights[1:], strict=True)), factors[0] * weights[0])
    boosted = F.least(F.lit(1.0), plain + F.least(F.lit(0.3), persistence * 0.05))
    composite = F.when(persistence > 0, boosted).otherwise(plain)
    names = ("maturity", "sample_size", "freshness", "deployment")
    parts = F.struct(*[F.round(f, 4).alias(n) for n, f in zip(names, factors, strict=True)])
    return F.struct(F.round(composite, 4).alias("score"), confidence_level(composite).alias("level"), parts.alias("factors"))


def severity(score: Column) -> Column:
    return _steps(score, C.SEVERITIES, None)


def should_alert(score: Column, level: Column) -> Column:
    return (
        (score >= 8)
        | (score >= 6) & level.isin("moderate", "high", "production_trusted")
        | (score >= 4) & level.isin("high", "production_trusted")
        | (score >= 2) & (level == "production_trusted")
    )


def should_recompute_baseline(current: Column, base: Column, age_hours: Column | float = 0.0, days: Column | int = 7) -> Column:
    age = F.lit(age_hours) if isinstance(age_hours, (int, float)) else age_hours
    half = (F.lit(days) if isinstance(days, int) else days) * 12
    grown = (current - base) / F.when(base != 0, base) >= 0.10
    return F.when(base == 0, current >= 10).otherwise(F.when((half > 0) & (age >= half), True).otherwise(grown))


def is_post_deploy(deployed: Column, as_of: Column, grace_minutes: float = 30) -> Column:
    minutes = (F.unix_micros(as_of) - F.unix_micros(deployed)) / 60e6
    return F.coalesce(minutes < grace_minutes, F.lit(False))
