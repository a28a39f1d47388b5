"""Divergences and test statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftjobs.constants import LAPLACE_EPSILON, Z_CAP

TINY = 1e-10


def finite_only(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite_only(x), F.lit(0.0))


def clamp_z(z: Column) -> Column:
    return F.greatest(F.lit(-Z_CAP), F.least(F.lit(Z_CAP), z))


def _unbounded(difference: Column) -> Column:
    """The score of a difference without spread: none, or 5 either way."""
    return F.when(F.abs(difference) < TINY, 0.0).otherwise(5.0 * F.signum(difference))


def rate_z_score(observed: Column, mean: Column, std: Column) -> Column:
    spread = F.when(std >= TINY, std)
    return F.when(spread.isNull(), _unbounded(observed - mean)).otherwise((observed - mean) / spread)


def proportion_z_test(observed: Column, base: Column, n: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(0.9999), base))
    count = F.when(n > 0, n)
    se = F.sqrt(p * (1 - p) / count)
    z = F.when(se < TINY, _unbounded(observed - base)).otherwise((observed - base) / se)
    return F.when(count.isNull(), 0.0).otherwise(z)


def safe_pct_change(observed: Column, base: Column) -> Column:
    size = F.when(F.abs(base) >= TINY, F.abs(base))
    return F.when(size.isNull(), F.when(F.abs(observed) < TINY, 0.0).otherwise(100.0)).otherwise((observed - base) / size * 100)


def aligned(p: Column, q: Column) -> Column:
    """Two maps of category to weight as an array of pairs (p, q) over all categories, absent ones 0; no shuffle. A null map is empty."""
    given = lambda m: F.coalesce(m, F.create_map().cast("map<string,double>"))
    pair = lambda k, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("p"), F.coalesce(b, F.lit(0.0)).alias("q"))
    return F.map_values(F.map_zip_with(given(p), given(q), pair))


def _bound(x: Column, f) -> Column:
    """f of x, with x made once, however often f names it: a lambda over an array of one element binds it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def smoothed(pairs: Column, epsilon: float = LAPLACE_EPSILON) -> Column:
    """Laplace-smoothed shares of aligned pairs; a side without weight is uniform."""
    add = lambda acc, x: F.struct((acc["p"] + x["p"]).alias("p"), (acc["q"] + x["q"]).alias("q"))
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))

    def summed(own: Column) -> Column:
        return F.struct(own.alias("pairs"), F.aggregate(own, zero, add).alias("sums"), F.greatest(F.size(own), F.lit(1)).cast("double").alias("size"))

    def shares(own: Column) -> Column:
        whole = lambda side: own["sums"][side] + epsilon * own["size"]
        part = lambda x, side: F.when(whole(side) > 0, (x[side] + epsilon) / whole(side)).otherwise(1 / own["size"]).alias(side)
        return F.transform(own["pairs"], lambda x: F.struct(part(x, "p"), part(x, "q")))

    return _bound(_bound(pairs, summed), shares)


def _sum_over(p: Column, q: Column, term) -> Column:
    """A sum over smoothed shares; no categories: 0."""
    return F.aggregate(smoothed(aligned(p, q)), F.lit(0.0), lambda acc, x: acc + term(x["p"], x["q"]))


def jensen_shannon_divergence(p: Column, q: Column) -> Column:
    """In bits, between 0 and 1; two empty maps: 0."""

    def term(a: Column, b: Column) -> Column:
        middle = (a + b) / 2
        return 0.5 * a * F.log2(a / middle) + 0.5 * b * F.log2(b / middle)

    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _sum_over(p, q, term)))


def kl_divergence(p: Column, q: Column) -> Column:
    return _sum_over(p, q, lambda a, b: a * F.log2(a / b))


def population_stability_index(base: Column, current: Column) -> Column:
    return F.greatest(F.lit(0.0), _sum_over(base, current, lambda e, a: (a - e) * F.ln(a / e)))


def shannon_entropy(values: Column) -> Column:
    """In bits, of the values of an array, nulls among them; none: 0. Equal values are counted in one pass over the sorted array."""
    weigh = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def entropy(own: Column) -> Column:
        start = F.struct(F.get(own, F.lit(0)).alias("value"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))

        def step(acc: Column, x: Column) -> Column:
            same = acc["value"].eqNullSafe(x)
            return F.struct(x.alias("value"), F.when(same, acc["n"] + 1).otherwise(1.0).alias("n"), F.when(same, acc["s"]).otherwise(acc["s"] + weigh(acc["n"])).alias("s"))

        total = F.size(own).cast("double")
        return F.aggregate(own, start, step, lambda acc: F.log2(total) - (acc["s"] + weigh(acc["n"])) / total)

    return F.when(F.size(values) > 0, _bound(F.array_sort(values), entropy)).otherwise(0.0)
