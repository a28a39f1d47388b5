"""What follows a score: feeds, metrics, suppression, deduplication, evidence and routing.

The tables of the second half are declared by the data model alone; their operators are extensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.constants import ALERT_KEY_SECONDS, ERROR_STATUS
from driftjobs.operators.features import quantiles
from driftjobs.operators.keys import join_same

#: Powers of two hours that bins have, and hours beyond which all times are one (some 30,000 years).
LEVELS, EVER = 30, 1 << 28
EVENT = ("endpoint_id", "segmentation_key", "org_id", "project_id", "drift_score", "confidence_score", "confidence_state", "severity", "alert_type", "model_version", "timestamp", "baseline_snapshot_time", "summary", "components")
PARTS = ("feature_name", "drift_type", "baseline_value", "observed_value", "deviation_z", "deviation_pct", "weight")


def to_drift_events(scored: DataFrame, time: Column | None = None) -> DataFrame:
    """Alerting windows as the 14 text fields of EVENT, with defaults for what is missing; ``components`` is a JSON list.

    ``time`` is when a window was scored (else its start). Organisation and project are empty where ``scored`` has no such columns.
    """
    missing = {c: F.lit(None).cast("string") for c in ("org_id", "project_id") if c not in scored.columns}
    rows = scored.where("alert_triggered").withColumns({**missing, "__time": F.col("window_start") if time is None else time})
    text = lambda c, otherwise="": F.coalesce(F.col(c).cast("string"), F.lit(otherwise))
    parts = F.transform("found", lambda x: F.struct(*[x[c].alias(c) for c in PARTS]))
    values = {
        "endpoint_id": F.col("endpoint_id"),
        "segmentation_key": F.col("segmentation_key"),
        "org_id": text("org_id"),
        "project_id": text("project_id"),
        "drift_score": text("score"),
        "confidence_score": text("confidence_score", "0"),
        "confidence_state": text("confidence_level", "low"),
        "severity": text("severity", "low"),
        "alert_type": text("alert_type", "behavioral_drift"),
        "model_version": text("model_version"),
        "timestamp": text("__time"),
        "baseline_snapshot_time": text("baseline_time"),
        "summary": F.col("summary"),
        "components": F.coalesce(F.to_json(parts), F.lit("[]")),
    }
    return rows.select(*[values[c].alias(c) for c in EVENT])


def drift_feed(events: DataFrame) -> DataFrame:
    """Six fields of each event, the score as a number, 0 if it has none."""
    score = F.coalesce(F.expr("try_cast(drift_score as double)"), F.lit(0.0)).alias("drift_score")
    return events.select("endpoint_id", score, "severity", "alert_type", F.col("confidence_state").alias("confidence"), "timestamp")


def alert_feed(events: DataFrame) -> DataFrame:
    """As ``drift_feed``, with the summary in place of the confidence, of high and critical events."""
    feed = drift_feed(events.where(F.col("severity").isin("high", "critical")).withColumn("confidence_state", F.col("summary")))
    return feed.withColumnRenamed("confidence", "summary")


def ingestion_metrics(obs: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Rows, errors, average and p95 latency of each endpoint by time bucket."""
    by = ("endpoint_id", "bucket")
    rows = obs.withColumn("bucket", F.window("time", bucket)["start"])
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("observations_count"),
        F.count_if(F.col("status_code") >= ERROR_STATUS).alias("errors_count"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
    p95 = quantiles(rows, by, "latency_ms", (0.95,)).select(*by, F.col("q")[0].alias("p95_latency_ms"))
    return join_same(sums, p95, by, "left")


def dyadic_cover(first: Column, last: Column) -> Column:
    """The bins (level, no) that together are the steps ``first`` to ``last``, both included: at most two of each level.

    A bin of level k holds ``2 ** k`` steps from a multiple of that on. Of what is left at a level, an odd first bin and an even last
    one stand there; all others pair up for the next level.
    """
    bins = []
    for k in range(LEVELS):
        begin, end = F.ceil(first / F.lit(1 << k)).cast("long"), F.floor((last + 1) / F.lit(1 << k)).cast("long")
        for edge, no in ((begin, begin), (end, end - 1)):
            bins.append(F.when((begin < end) & (F.pmod(edge, F.lit(2)) == 1), F.struct(F.lit(k).alias("level"), no.alias("no"))))
    return F.array_compact(F.array(*bins))


def suppress_alerts(alerts: DataFrame, suppression: DataFrame) -> DataFrame:
    """Alerts outside of their endpoint's suppression windows, both ends of which count as inside.

    An interval anti-join with equal keys: a window is cut into bins of hours times a power of two (``dyadic_cover``: some thirty for
    ten years), an alert's time lies in one bin of each power that occurs, and times decide in the bins. A window that ends before it
    starts covers nothing. One without an end goes on for ever, one without a start has always been; without both,
    or without an endpoint, it covers nothing. Alerts without a time or an endpoint stay.
    """
    hours = lambda c: F.floor(F.unix_micros(c) / F.lit(3_600_000_000))
    hour = lambda c, otherwise: F.coalesce(F.when(F.col(c).isNotNull(), F.greatest(F.lit(-EVER), F.least(F.lit(EVER), hours(c)))), F.lit(otherwise)).cast("long")
    starts, ends = F.col("starts_at"), F.col("ends_at")
    told = suppression.where(F.col("endpoint_id").isNotNull() & F.coalesce(starts, ends).isNotNull() & F.coalesce(starts <= ends, F.lit(True)))
    bins = told.select(F.col("endpoint_id").alias("__e"), starts.alias("__from"), ends.alias("__to"), F.explode(dyadic_cover(hour("starts_at", -EVER), hour("ends_at", EVER))).alias("__bin"))
    levels = sorted(r[0] for r in bins.select("__bin.level").distinct().collect())  # LEVELS at most
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(hour("created_at", 0) / F.lit(1 << k)).cast("long").alias("no")) for k in levels or [0]])
    times = alerts.select("endpoint_id", "created_at").where("endpoint_id is not null and created_at is not null").distinct().withColumn("__own", F.explode(own))
    inside = (F.col("endpoint_id") == F.col("__e")) & (F.col("__own") == F.col("__bin")) & F.coalesce(F.col("created_at") >= F.col("__from"), F.lit(True)) & F.coalesce(F.col("created_at") <= F.col("__to"), F.lit(True))
    covered = times.join(bins, inside, "left_semi").select("endpoint_id", "created_at").distinct()
    return alerts.join(covered, ["endpoint_id", "created_at"], "left_anti").select(*alerts.columns)


def _sessions(alerts: DataFrame, life: int, by: Sequence[str], grain: int) -> DataFrame:
    """``alerts`` with ``__at`` and ``__session``: when, in its kind, the latest gap of ``life`` or more before it ended.

    Within a stretch of time (``grain``) of a kind gaps show between neighbours; what comes over from the stretches before it,
    of which a kind has one row each, is their last time and their last beginning. So a busy kind spreads over its stretches.
    """
    key = [*by, "__grain"]
    rows = alerts.withColumn("__at", F.unix_micros("created_at")).withColumn("__grain", F.floor(F.col("__at") / F.lit(grain)))
    inside = Window.partitionBy(*key).orderBy("__at")
    rows = rows.withColumn("__gap", F.col("__at") - F.lag("__at").over(inside))
    ends = rows.groupBy(*key).agg(F.min("__at").alias("__first"), F.max("__at").alias("__last"), F.max(F.when(F.col("__gap") >= life, F.col("__at"))).alias("__begun"))
    order = Window.partitionBy(*by).orderBy("__grain")
    fresh = F.lag("__last").over(order).isNull() | (F.col("__first") - F.lag("__last").over(order) >= life)
    ends = ends.withColumn("__fresh", F.when(fresh, F.col("__first")))
    # The beginning that holds at a stretch's first alert: its own if a gap lies before it, else the last one of the stretches before.
    ends = ends.withColumn("__known", F.max(F.coalesce("__begun", "__fresh")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*key, F.coalesce("__fresh", "__known").alias("__opening"))
    rows = join_same(rows, ends, key)
    begun = F.max(F.when(F.col("__gap") >= life, F.col("__at"))).over(inside)
    return rows.withColumn("__session", F.coalesce(begun, "__opening")).drop("__gap", "__opening", "__grain")


def dedup_alerts(alerts: DataFrame, seconds: int = ALERT_KEY_SECONDS, by: Sequence[str] = ("endpoint_id", "alert_type"), tie: str = "id") -> DataFrame:
    """Alerts that find no key of their kind: one that is kept sets it, and it lives ``seconds`` from then on, whatever comes meanwhile.

    A gap of that length always finds no key. So a kind falls into sessions between such gaps, which stand for themselves
    and spread over tasks; in a session alerts pass in order of time (then ``tie``) through one small state, as a stream of
    sorted rows that spills, and none is held. Only a session without any gap is one task, however long it lasts. Null kinds are
    kinds; alerts without a time are one moment before all others.
    """
    life = seconds * 1_000_000
    rows = _sessions(alerts, life, by, 24 * life)
    schema = alerts.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, until = None, None
        for batch in batches:
            own_sessions = list(zip(*[batch.column(c).to_pylist() for c in (*by, "__session")], strict=True))
            kept = []
            for own, at in zip(own_sessions, batch.column("__at").to_pylist(), strict=True):
                fresh = own != session or at is not None and (until is None or at >= until)
                if fresh:
                    session, until = own, None if at is None else at + life
                kept.append(fresh)
            yield batch.filter(pa.array(kept, pa.bool_())).drop_columns(["__at", "__session"])

    laid = rows.select(*alerts.columns, "__at", "__session").repartition(*by, "__session").sortWithinPartitions(*by, "__session", "__at", tie)
    return laid.mapInArrow(keep, schema)


def alert_evidence(components: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each component with the time range of its window."""
    return join_same(components, windows.select(*by, "window_end"), by).withColumn("time_window", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")))


def route_alerts(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """A row for each alert and active channel of its organisation, the severity in the channel's words."""
    # Severities of one kind of channel.
    paging = F.create_map(*[F.lit(x) for x in ("critical", "critical", "high", "error", "medium", "warning", "low", "info")])
    rows = alerts.join(channels.where("is_active").select("org_id", F.col("name").alias("channel"), F.col("type").alias("channel_type")), "org_id")
    return rows.withColumn("channel_severity", F.when(F.col("channel_type") == "pagerduty", F.coalesce(paging[F.col("severity")], F.lit("warning"))).otherwise(F.col("severity")))
