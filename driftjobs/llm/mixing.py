"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.llm.common import attach, discard, written

#: Steps of the distribution kept beyond its mean, in standard deviations and in all: what lies beyond has a chance below 1e-15.
DEVIATIONS, MORE_STEPS = 10, 30
UNIFORM_BITS = 52
#: Copies of a row that one list makes.
COPIES_AT_ONCE = 4096


def uniform(key: F.Column, seed: int) -> F.Column:
    """A number in (0, 1) from the MD5 of the seed and the key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    return (F.conv(F.substring(digest, 1, UNIFORM_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << UNIFORM_BITS)


def poisson_steps(rates: DataFrame) -> DataFrame:
    """Rows of ``source`` and ``rate`` with ``first`` and ``steps``: P(X <= k) for k = first, first + 1, ... of a Poisson distribution.

    Steps lie within DEVIATIONS of the mean: what lies before ``first`` is below any number that is drawn.
    Each step is a row, and sums run over the rows of a source, of which there are 20 sqrt(rate) + 31 at most.
    """
    rate, k = F.col("rate"), F.col("k")
    around = DEVIATIONS * F.sqrt(rate)
    first = F.greatest(F.lit(0), F.floor(rate - around)).cast("long")
    last = F.ceil(rate + around + MORE_STEPS).cast("long")
    rows = rates.where("rate > 0").select("source", "rate", first.alias("first"), F.explode(F.sequence(first, last)).alias("k"))
    by_k = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("first").cast("double")
    before = F.when(start > 0, start * F.ln(start) - start + F.ln(2 * math.pi * start) / 2 + 1 / (12 * start)).otherwise(0.0)  # logarithm of the factorial of ``first``
    since = F.sum(F.when(k > F.col("first"), F.ln(k.cast("double"))).otherwise(0.0)).over(by_k)
    terms = rows.withColumn("p", F.exp(k * F.ln(rate) - rate - before - since))
    sums = terms.withColumn("below", F.sum("p").over(by_k))
    lists = sums.groupBy("source", "first").agg(F.array_sort(F.collect_list(F.struct("k", "below"))).alias("x"))
    return lists.select("source", "first", F.col("x.below").alias("steps"))


def steps_below(steps: F.Column, u: F.Column) -> F.Column:
    """How many of the rising steps are below u, by halving."""
    size = F.size(steps)
    top = F.floor(F.log2(size.cast("double"))).cast("int")

    def halve(at: F.Column, i: F.Column) -> F.Column:
        further = at + F.call_function("shiftleft", F.lit(1), top - i)
        return F.when((further <= size) & (F.get(steps, further - 1) < u), further).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), top), F.lit(0), halve)


def source_rates(docs: DataFrame, source_col: str, size: F.Column, weights: Mapping[str, float] | None, total: float | None) -> DataFrame:
    """One row per source: its size and its mean repetition rate.

    The rate is ``weight / sum of weights * total / size``. Without weights all sources weigh the same, the
    null source too; with them, a source that isn't named has weight 0. Without a total, the mix is as large
    as the input. A source of size 0 has rate 0.
    """
    sizes = written(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, 1.0).otherwise(0.0))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.coalesce(named[F.col("source")], F.lit(0.0))).otherwise(0.0))
    sums = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("total"))  # one row
    goal = F.col("total") if total is None else F.lit(float(total))
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.col("weights") * goal / F.col("size")).otherwise(0.0)
    return weighed.join(F.broadcast(sums)).select("source", "size", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = 17,
) -> DataFrame:
    """``docs`` with each row repeated a Poisson number of times, so that sources have their target weights by bytes of text.

    The number is the inverse of the distribution at a uniform number that seed and id decide: the same on
    every run and machine. Rows of one id repeat alike; rows without an id share one number. ``copy_no`` counts
    from 1, and ``shuffle_key`` is a hash by which rows lie in random partitions and, within each, in random
    order; they replace columns of those names. Null sources are a source; null and empty texts have size 0;
    texts are whole, whatever their length. An empty table stays empty. A source that is repeated r times on
    average takes 20 sqrt(r) + 31 steps at most, and a copy is a row from the start.
    """
    rates = written(source_rates(docs, source_col, F.coalesce(F.octet_length(text_col), F.lit(0)), weights, total))
    steps = written(poisson_steps(rates).select(F.col("source").alias("__source"), F.col("first").alias("__first"), F.col("steps").alias("__steps")))
    discard(rates)
    placed = attach(docs.withColumn("__source", F.col(source_col)), steps, "__source", F.size("__steps") + 1).drop("__source")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    number = F.when(F.col("__steps").isNull(), 0).otherwise(F.col("__first") + steps_below(F.col("__steps"), F.col("__u")))
    drawn = placed.withColumn("__u", uniform(key, seed)).withColumn("__n", number.cast("long")).drop("__steps", "__first", "__u")
    hundreds = drawn.where("__n > 0").withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(COPIES_AT_ONCE).cast("long"))))
    until = F.least(F.col("__n"), F.col("__from") + COPIES_AT_ONCE - 1)
    copies = hundreds.withColumn("copy_no", F.explode(F.sequence(F.col("__from"), until))).withColumn("copy_no", F.col("copy_no").cast("int")).drop("__n", "__from")
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), key, "copy_no")))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
