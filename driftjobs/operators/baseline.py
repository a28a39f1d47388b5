"""Baselines: feature vectors merged with weights that fade with age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.constants import EWMA_ALPHA, KEY, MAX_ENUM
from driftjobs.functions.confidence import maturity_state, window_days
from driftjobs.operators.keys import join_same

RESPONSE = ("p50", "p95", "p99", "mean", "std", "size_mean", "size_std", "size_p95")


def ewma_weight(age: Column, alpha: float = EWMA_ALPHA) -> Column:
    return F.pow(F.lit(1 - alpha), age)


def weighted_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors with ``age`` (see ``baseline_vectors``) and ``c``, their weight: samples times what is left of them at their age."""
    return vectors.withColumn("c", F.col("sample_count") * ewma_weight(F.col("age")))


def _mean(value: Column, weight: Column) -> Column:
    """Weighted mean over the rows that have the value; plain mean if these weigh nothing."""
    has = value.isNotNull()
    total = F.sum(F.when(has, weight))
    return F.when(total > 0, F.sum(value * weight) / F.when(total > 0, total)).otherwise(F.avg(value))


def baseline_response(vectors: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Merged statistics and entropy, total samples, maturity and look-back of each key. Vectors without samples count for nothing."""
    c = F.when(F.col("sample_count") > 0, F.col("c"))
    mean = lambda name: F.coalesce(F.sum(F.col(name) * c) / F.sum(c), F.lit(0.0))
    merged = vectors.groupBy(*by).agg(
        *[mean(n).alias(n) for n in RESPONSE],
        F.round(mean("payload_entropy"), 4).alias("payload_entropy"),
        F.sum("sample_count").alias("sample_count"),
        F.max("window_start").alias("baseline_time"),
    )
    merged = merged.withColumn("maturity_state", maturity_state(F.col("sample_count")))
    return merged.withColumn("window_days", window_days(F.col("maturity_state")))


def daily_sums(vectors: DataFrame, by: Sequence[str] = KEY, alpha: float = EWMA_ALPHA) -> DataFrame:
    """What a day's vectors add to a baseline, one row for each key and day: weighted sums, and how many vectors there are.

    Weights fade with each later vector of the key. Within the day they are what they are; all later days together make them
    fade by one factor, which follows from how many vectors those have. So days are kept, and never read again.
    """
    day = [*by, "day"]
    rows = vectors.withColumn("day", F.to_date("window_start"))
    rows = rows.withColumn("age", F.row_number().over(Window.partitionBy(*day).orderBy(F.col("window_start").desc())) - 1)
    c = F.when(F.col("sample_count") > 0, F.col("sample_count") * ewma_weight(F.col("age"), alpha))
    return rows.groupBy(*day).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.sum("sample_count").alias("sample_count"),
        F.sum(c).alias("weight"),
        *[F.sum(F.col(n) * c).alias(n) for n in (*RESPONSE, "payload_entropy")],
        F.max("window_start").alias("baseline_time"),
    )


def baselines_of_days(sums: DataFrame, as_of: DataFrame, days: int, by: Sequence[str] = KEY, alpha: float = EWMA_ALPHA) -> DataFrame:
    """As ``baseline_response`` over the vectors of the last ``days`` days and the day ``as_of`` itself, for every day in ``as_of`` (one
    date column), from ``daily_sums``: adding a day costs its own row, and a day that leaves is just not summed.

    One row for each key that has vectors, and day. There are ``days`` + 1 rows a key and day in its sum, however many vectors there were.
    """
    shifts = F.explode(F.sequence(F.lit(0), F.lit(days)))
    rows = sums.withColumn("__shift", shifts).withColumn("as_of", F.date_add("day", F.col("__shift")))
    rows = rows.join(as_of.select(F.col(as_of.columns[0]).alias("as_of")).distinct(), "as_of", "left_semi")
    later = Window.partitionBy(*by, "as_of").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__f", ewma_weight(F.coalesce(F.sum("vectors").over(later), F.lit(0)), alpha))
    mean = lambda n: F.coalesce(F.sum(F.col(n) * F.col("__f")) / F.nullif(F.sum(F.col("weight") * F.col("__f")), F.lit(0.0)), F.lit(0.0))
    merged = rows.groupBy(*by, "as_of").agg(*[mean(n).alias(n) for n in RESPONSE], F.round(mean("payload_entropy"), 4).alias("payload_entropy"), F.sum("sample_count").alias("sample_count"), F.max("baseline_time").alias("baseline_time"))
    merged = merged.withColumn("maturity_state", maturity_state(F.col("sample_count")))
    return merged.withColumn("window_days", window_days(F.col("maturity_state")))


def baseline_status(vectors: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Shares of status codes, weighed by samples alone; a code that a window lacks is 0 there."""
    own = vectors.where("sample_count > 0")
    totals = own.groupBy(*by).agg(F.sum("sample_count").alias("total"))
    rates = own.select(*by, "sample_count", F.explode("status_codes").alias("code", "rate"))
    sums = rates.groupBy(*by, "code").agg(F.sum(F.col("rate") * F.col("sample_count")).alias("s"))
    return join_same(sums, totals, by).select(*by, "code", F.round(F.col("s") / F.col("total"), 6).alias("rate"))


def baseline_fields(fields: DataFrame, vectors: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Merged features of each path, over the windows that have it; their ages count all windows of the key.

    ``vectors`` has ``sample_count``, ``age`` and ``c`` of each window. Numbers are merged over windows with
    a mean, strings and lists over those with a mean length, entropies over those with one. The dominant
    type is the latest, ranges and vocabularies are the widest.
    """
    window = [*by, "window_start"]
    rows = join_same(fields, vectors.select(*window, "sample_count", "c"), window)
    c = F.col("c")
    numeric, lengths = F.col("mean").isNotNull(), F.col("mean_length").isNotNull()
    over = lambda name, has: F.round(_mean(F.when(has, F.coalesce(F.col(name), F.lit(0.0))), c), 6).alias(name)
    merged = rows.groupBy(*by, "path").agg(
        F.sum("sample_count").alias("__weight"),
        *[F.round(_mean(F.col(n), c), 6).alias(n) for n in ("presence_rate", "null_rate", "type_consistency")],
        F.max_by("dominant_type", "window_start").alias("dominant_type"),
        *[over(n, numeric) for n in ("mean", "std", "p25", "p50", "p75", "p95", "p99")],
        F.min(F.when(numeric, F.col("min_val"))).alias("min_val"),
        F.max(F.when(numeric, F.col("max_val"))).alias("max_val"),
        *[over(n, lengths) for n in ("mean_length", "std_length")],
        F.max(F.when(lengths, F.col("vocabulary_size"))).alias("vocabulary_size"),
        F.round(_mean(F.when(lengths, F.col("vocabulary_entropy")), c), 6).alias("vocabulary_entropy"),
    )
    return join_same(merged.where(F.col("__weight") > 0).drop("__weight"), baseline_enums(rows, by), [*by, "path"], "left")


def baseline_enums(rows: DataFrame, by: Sequence[str] = KEY, most: int = MAX_ENUM) -> DataFrame:
    """Shares of a path's values, weighed by samples over the windows that list values; the first ``most`` values by name."""
    listed = rows.where(F.col("mean_length").isNotNull() & (F.size("enum_distribution") > 0))
    totals = listed.groupBy(*by, "path").agg(F.sum("sample_count").alias("total"))
    sums = listed.select(*by, "path", "sample_count", F.explode("enum_distribution").alias("value", "share")).groupBy(*by, "path", "value").agg(F.sum(F.col("share") * F.col("sample_count")).alias("s"))
    shares = join_same(sums, totals.where("total > 0"), [*by, "path"]).withColumn("share", F.round(F.col("s") / F.col("total"), 6))
    first = shares.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "path").orderBy("value"))).where(F.col("__rank") <= most)
    return first.groupBy(*by, "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "share")))).alias("enum_distribution"))


def compute_baseline(vectors: DataFrame, fields: DataFrame, by: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Response-level and field baselines of chosen vectors (see ``baseline_vectors``). A computed baseline has no schema hash."""
    weighed = weighted_vectors(vectors)
    codes = baseline_status(weighed, by).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "rate")))).alias("status_codes"))
    responses = join_same(baseline_response(weighed, by), codes, by, "left").withColumn("schema_hash", F.lit(None).cast("string"))
    return responses, baseline_fields(fields, weighed, by)
