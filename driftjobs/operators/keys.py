"""Joins on keys of which some may be null: a null key is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """As ``left.join(right, by, how)``, but null equals null. Spark plans it as an equi-join."""
    other = right.withColumnsRenamed({c: f"__same_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__same_{c}")) for c in by]
    joined = left.join(other, on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full_outer", "right"):
        joined = joined.withColumns({c: F.coalesce(c, f"__same_{c}") for c in by})
    return joined.drop(*[f"__same_{c}" for c in by])
