"""Jobs: features, baselines and scores of all keys at once, for live windows, backfills and replays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftjobs.constants import KEY
from driftjobs.functions.confidence import confidence, should_alert
from driftjobs.operators.baseline import compute_baseline
from driftjobs.operators.drift import score_drift
from driftjobs.operators.features import count_values, field_features, response_features
from driftjobs.operators.keys import join_same
from driftjobs.operators.windows import anomaly_persistence, baseline_vectors, newest, replay_chunks, tumbling_windows
from driftjobs.sources.io import discard, written

BY = (*KEY, "window_start")


def extract_features(obs: DataFrame, by: Sequence[str] = BY) -> tuple[DataFrame, DataFrame]:
    """Response-level and field vectors of rows that have the key columns of their window, written for the steps that read them."""
    counts = count_values(obs, by)
    vectors = written(response_features(obs, by, counts)), written(field_features(counts, by))
    discard(counts)
    return vectors


def recompute_baselines(responses: DataFrame, fields: DataFrame, as_of: Column, days: Column | int = 7, keep: str = "oldest", min_lookback_days: int = 3) -> tuple[DataFrame, DataFrame]:
    """Baselines of all keys as of a time. Looking back less than ``min_lookback_days`` would find nothing, so it isn't done."""
    days = max(days, min_lookback_days) if isinstance(days, int) else F.greatest(days, F.lit(min_lookback_days))
    base, base_fields = compute_baseline(baseline_vectors(responses, as_of, days, keep=keep), fields)
    return written(base), written(base_fields)


def decide(scored: DataFrame, base: DataFrame, as_of: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Scores with confidence, level and the decision to alert.

    ``persistence`` and ``deployment_recency_hours`` are columns of ``scored``. Windows whose key has no
    baseline never alert; their confidence is null.
    """
    known = base.select(*key, F.col("sample_count").alias("base_count"), "baseline_time", "maturity_state", "window_days")
    rows = join_same(scored, known, key, "left")
    age = (F.unix_micros(as_of) - F.unix_micros("baseline_time")) / 3.6e9
    found = confidence(F.col("maturity_state"), F.col("base_count"), age, F.col("window_days"), F.col("deployment_recency_hours"), F.col("persistence"))
    rows = rows.withColumn("__c", F.when(F.col("base_count") > 0, found))
    rows = rows.withColumns({"confidence_score": F.col("__c.score"), "confidence_level": F.col("__c.level")}).drop("__c", "base_count", "window_days")
    return rows.withColumn("alert_triggered", F.coalesce(should_alert(F.col("score"), F.col("confidence_level")), F.lit(False)))


def with_baseline(scored: DataFrame, base: DataFrame) -> DataFrame:
    """Windows whose key has a baseline: others neither have persistence nor change it."""
    return join_same(scored, base.where("sample_count > 0").select(*KEY), KEY, "left_semi")


def score_batch(responses: DataFrame, fields: DataFrame, base: DataFrame, base_fields: DataFrame, as_of: Column, recency: Column | None = None, by: Sequence[str] = BY, state: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Windows with score, severity, confidence, decision and summary; the persistence that a window meets is that of those before it.

    ``state`` is the persistence of keys before the first of these windows (``persistence_state``). ``extra`` has other columns of
    windows, which stay, and which ``as_of`` and ``recency`` may name.
    """
    scored = written(score_drift(responses, fields, base, base_fields, by))
    lasting = anomaly_persistence(with_baseline(scored, base), KEY, by[-1], state=state).select(*by, "persistence")
    rows = join_same(scored, lasting, by, "left").withColumn("persistence", F.coalesce("persistence", F.lit(0)))
    rows = rows if extra is None else join_same(rows, extra, by, "left")
    return written(decide(rows.withColumn("deployment_recency_hours", recency if recency is not None else F.lit(None).cast("double")), base, as_of))


def replay(obs: DataFrame, base: DataFrame, base_fields: DataFrame, as_of: Column, size: int = 100) -> DataFrame:
    """Past observations in chunks of ``size`` rows an endpoint, scored against given baselines; the last chunk may be short.

    Every endpoint has one baseline of its own (``endpoint_id`` alone is the key).
    """
    key, by = ("endpoint_id",), ("endpoint_id", "chunk")
    chunks = written(replay_chunks(obs, size))
    responses, fields = extract_features(chunks, by)
    scored = score_drift(responses, fields, base, base_fields, by, key)
    bounds = chunks.groupBy(*by).agg(F.min("time").alias("window_start"), F.max("time").alias("window_end"))
    rows = join_same(scored, bounds, by).withColumns({"persistence": F.lit(0), "deployment_recency_hours": F.lit(None).cast("double")})
    return decide(rows, base, as_of, key)


def replay_summary(scored: DataFrame) -> DataFrame:
    """One row: windows, alerts, average and greatest score, observations."""
    return scored.agg(
        F.count(F.lit(1)).alias("windows"),
        F.count("severity").alias("alerts"),
        F.coalesce(F.round(F.avg("score"), 4), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("observations"),
    )


def run_pipeline(obs: DataFrame, split: Column, as_of: Column, duration: str = "15 minutes", look_back_days: int = 30, max_per_window: int | None = None) -> DataFrame:
    """From observations to decisions: windows before ``split`` make the baselines, the others are scored.

    Whole windows count unless ``max_per_window`` is given (the monitor's old guard was NEWEST_PER_WINDOW rows).
    """
    rows = tumbling_windows(obs, duration)
    if max_per_window is not None:
        rows = newest(rows, BY, max_per_window)
    responses, fields = extract_features(rows)
    before = F.col("window_start") < split
    base, base_fields = recompute_baselines(responses.where(before), fields.where(before), split, look_back_days)
    return score_batch(responses.where(~before), fields.where(~before), base, base_fields, as_of)
