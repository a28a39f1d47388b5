"""The monitor's main loop as a stream: observations, counted values of open windows, scores of those that close.

State is what is counted: a row for each value that an open window has, added to as rows come, and ended by the watermark. It is dealt by
window and value and lies in RocksDB (``with_rocks``): no window or path is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftjobs.constants import KEY
from driftjobs.jobs.batch import BY, score_batch, with_baseline
from driftjobs.operators.alerts import to_drift_events
from driftjobs.operators.features import VALUE, assemble_feature_vector, counted, field_features, response_level, summaries, values_of
from driftjobs.operators.keys import join_same
from driftjobs.operators.windows import persistence_state
from driftjobs.sources.io import discard, read_batch_before, write_scored_windows, written
from driftjobs.streaming.streams import with_rocks

Baselines = Callable[[SparkSession], tuple[DataFrame, DataFrame]]


def closed_values(obs: DataFrame, duration: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counted values of the windows of a stream of observations, each window once, when the watermark has passed its end.

    As ``counted`` gives them for a batch: what closed windows have is equal to that. Rows without a time are in no window; rows that
    come after their window's close are dropped, and Spark counts them.
    """
    with_rocks(obs.sparkSession)
    rows = obs.withWatermark("time", delay).withColumn("w", F.window("time", duration))
    own = [*KEY, "w"]
    return counted(values_of(rows, own), own).select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *VALUE, "n", "seen")


def vectors_of(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Response-level and field vectors of whole windows' counted values."""
    ends = counts.groupBy(*BY).agg(F.max("window_end").alias("window_end"))
    responses = response_level(summaries(counts.where("part <> 'leaf'").drop("window_end"), BY), BY)
    return join_same(responses, ends, BY), field_features(counts.drop("window_end"), BY)


def score_closed(path: str, baselines: Baselines, as_of: Column | None = None, recency: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``closed_values``: score the windows that have closed and write all that follows, or nothing.

    ``baselines`` is asked in every micro-batch, so windows meet the snapshots that are active when they close; a key without one
    scores 0 and never alerts. ``as_of`` (a column of windows; else the window's end) is when they are judged. ``recency`` adds
    ``deployment_recency_hours`` to windows, such as ``join_latest_deployment``.

    Written under ``path`` by batch (``read_scored_windows``): ``feature_vectors``, ``drift_scores``, ``drift_events``, and ``persistence``,
    the anomalous windows in a row of each key that has some, which the next batch goes on from. A batch that failed is done again
    from the same windows and the same state, and overwrites what it had written: once in effect.
    """

    def batch(closed: DataFrame, batch_id: int) -> None:
        counts = written(closed)
        if not counts.isEmpty():
            _score(counts, batch_id)
        discard(counts)

    def _score(counts: DataFrame, batch_id: int) -> None:
        spark = counts.sparkSession
        responses, fields = map(written, vectors_of(counts))
        base, base_fields = baselines(spark)
        state = read_batch_before(spark, path, "persistence", batch_id)
        judged = F.col("window_end") if as_of is None else as_of
        ends = responses.select(*BY, "window_end")
        extra, hours = (ends, None) if recency is None else (recency(ends), F.col("deployment_recency_hours"))
        scored = score_batch(responses, fields, base, base_fields, judged, hours, state=state, extra=extra)
        after = persistence_state(with_baseline(scored, base), state=state)
        vectors = assemble_feature_vector(responses, fields, BY)
        write_scored_windows(vectors, scored, path, batch_id, drift_events=to_drift_events(scored, F.col("window_end")), persistence=after)
        discard(responses, fields, scored)

    return batch
