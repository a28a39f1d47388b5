"""Alert summaries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftjobs.constants import DRIFT_LABELS, NO_DRIFT


def _fixed(x: Column, digits: int) -> Column:
    """x rounded to so many digits by its exact binary value, ties to even, which is what fixed-point text shows; the sign stays.

    The product with a power of ten is taken together with its rounding error, so that a tie is one.
    """
    scale, size = 10**digits, F.abs(x)
    split = 134217729.0 * size
    high = split - (split - size)
    product = size * float(scale)
    error = (high * float(scale) - product) + (size - high) * float(scale)
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | (rest == 0.5) & ((error > 0) | (error == 0) & (whole % 2 == 1))
    return F.when(x < 0, -1.0).otherwise(1.0) * (whole + F.when(up, 1.0).otherwise(0.0)) / float(scale)


def describe_component(c: Column) -> Column:
    """One drift component (a struct) in words."""
    kind, base, seen, z = c["drift_type"], c["baseline_value"], c["observed_value"], c["deviation_z"]
    name = F.replace(F.replace(c["feature_name"], F.lit("field."), F.lit("")), F.lit("."), F.lit(" → "))
    labels = F.create_map(*[F.lit(x) for pair in DRIFT_LABELS.items() for x in pair])
    label = F.coalesce(labels[kind], kind)
    tenth, part = lambda x: _fixed(x, 1), lambda x: _fixed(x, 4)
    text = F.format_string
    return (
        F.when(kind == "null_rate_spike", text("%s: %s from %.1f%% to %.1f%% (z=%.1f)", name, label, tenth(base * 100), tenth(seen * 100), tenth(z)))
        .when(kind == "field_disappeared", text("%s: %s (was present %.0f%% of the time)", name, label, _fixed(base * 100, 0)))
        .when(kind.isin("latency_shift", "response_size_shift"), text("%s: %s from %.1f to %.1f (%+.1f%%)", name, label, tenth(base), tenth(seen), tenth(c["deviation_pct"])))
        .when(kind == "enum_collapse", text("%s: %s (JSD-based, z=%.1f)", name, label, tenth(z)))
        .when(kind == "structural_change", text("%s: %s with %.0f%% presence", name, label, _fixed(seen * 100, 0)))
        .when(kind == "schema_type_change", text("%s: %s", name, label))
        .otherwise(text("%s: %s (baseline=%.4f, observed=%.4f, z=%.1f)", name, label, part(base), part(seen), tenth(z)))
    )


def alert_summary(score: Column, severity: Column, top: Column) -> Column:
    """A header and up to three components, the weightiest first; ``top`` is an array of them."""
    head = F.format_string("[%s] Drift score: %.2f.", F.upper(F.coalesce(severity, F.lit("none"))), _fixed(score, 2))
    parts = F.array_join(F.transform(top, describe_component), "; ")
    return F.when(F.coalesce(F.size(top), F.lit(0)) == 0, NO_DRIFT).otherwise(F.concat(head, F.lit(" "), parts, F.lit(".")))
