"""Reading and writing: observations, scored windows, snapshots, quarantine, retention and layout."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftjobs.constants import KEY, RETENTION_DAYS
from driftjobs.functions.payload import is_json
from driftjobs.operators.joins import with_active
from driftjobs.operators.windows import latest, newest, tumbling_windows

PAYLOAD = "endpoint_id string, segmentation_key string, request_id string, status_code int, latency_ms double, response_size_bytes int, payload_hash string, payload_sample string, time timestamp"
ENVELOPE = f"event_id string, event_type string, schema_version string, timestamp timestamp, organization_id string, project_id string, payload struct<{PAYLOAD.replace(' ', ':').replace(',:', ',')}>"


@cache
def _own_root(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master (tests) gets a folder of its own; on a cluster it is an error, for
    executors would write to their own disks.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_root(context.applicationId)
    return f"{root.rstrip('/')}/driftjobs-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: lineage ends here, and a lost executor loses nothing.

    The files go at the end of the application, or by ``discard``.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    go_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def go_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends."""
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/driftjobs-" in path:
                folder, files = _folder(df.sparkSession, path)
                files.delete(folder, True)
                files.cancelDeleteOnExit(folder)


def read_observations(obs: DataFrame, start: Column, end: Column, max_per_key: int | None = None, duration: str = "15 minutes") -> DataFrame:
    """Rows from start to end, both included; the newest ``max_per_key`` of each key and window if it is given.

    The filter reaches the scan, and on a table laid out by day it drops whole days.
    """
    rows = obs.where(F.col("time").between(start, end))
    if max_per_key is None:
        return rows
    capped = newest(tumbling_windows(rows, duration), [*KEY, "window_start"], max_per_key)
    return capped.drop("window_start", "window_end")


def parse_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Event envelopes (JSON text) as observations; a missing segment is "default". What doesn't parse has a null endpoint."""
    parsed = raw.withColumn("__e", F.from_json(F.col(value).cast("string"), ENVELOPE))
    rows = parsed.select("__e.event_id", "__e.organization_id", "__e.project_id", F.col("__e.timestamp").alias("event_time"), "__e.payload.*")
    return rows.withColumns({"segmentation_key": F.coalesce("segmentation_key", F.lit("default")), "time": F.coalesce("time", "event_time")})


def malformed(envelope: Column) -> Column:
    """Why an envelope can't be an observation: "not JSON" (``is_json``; nulls too) or "no endpoint"; else null."""
    text = F.make_valid_utf8(envelope)
    endpoint = F.from_json(text, ENVELOPE)["payload"]["endpoint_id"]
    return F.when(~F.coalesce(is_json(text), F.lit(False)), "not JSON").when(endpoint.isNull() | (endpoint == ""), "no endpoint")


def split_malformed(raw: DataFrame, quarantined_at: Column, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows that parse, and the others with their text, a reason and a time. Neither waits for the other."""
    judged = raw.withColumn("reason", malformed(F.col(value).cast("string")))
    bad = judged.where(F.col("reason").isNotNull()).select(F.col(value).alias("original"), "reason", quarantined_at.alias("quarantined_at"))
    return judged.where(F.col("reason").isNull()).drop("reason"), bad


def partition_by_day(df: DataFrame, time: str = "time", by: Sequence[str] = KEY) -> DataFrame:
    """``df`` with ``date``, dealt by day and hash of the key and sorted within, for ``write.partitionBy("date")``.

    A day spans as many tasks as its keys do, so a busy day is no single task.
    """
    dated = df.withColumn("date", F.to_date(time))
    return dated.repartition("date", *by).sortWithinPartitions(*by, F.col(time).desc())


def write_by_day(df: DataFrame, path: str, time: str = "time", by: Sequence[str] = KEY) -> None:
    """Write ``df`` by day, clustered by key: days that it has replace what was there of them, other days stay. Rows without a time are an own day."""
    laid = partition_by_day(df, time, by)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_days(spark: SparkSession, path: str, start: Column, end: Column, schema: T.StructType | None = None, time: str = "time") -> DataFrame:
    """Rows of a table written by day, from start to end, both included. Only files of these days are read."""
    rows = (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return rows.where(F.col("date").between(F.to_date(start), F.to_date(end)) & F.col(time).between(start, end))


def drop_old_days(spark: SparkSession, path: str, keep: int | str, as_of: dt.datetime) -> list[str]:
    """Retention of a table written by day: delete the folders of days that ended ``keep`` days before ``as_of`` (UTC) or earlier; which these were.

    No row is read. The day in which the limit falls stays; ``apply_retention`` takes the rest of it away where that matters.
    """
    limit = (as_of - dt.timedelta(days=RETENTION_DAYS[keep] if isinstance(keep, str) else keep)).date().isoformat()
    folder, files = _folder(spark, path)
    days = [status.getPath() for status in files.listStatus(folder)]
    old = sorted(day.getName() for day in days if re.fullmatch(r"date=\d{4}-\d\d-\d\d", day.getName()) and day.getName()[5:] < limit)
    for day in days:
        if day.getName() in old:
            files.delete(day, True)
    return [name[5:] for name in old]


def apply_retention(df: DataFrame, keep: int | str, as_of: Column, time: str = "time") -> DataFrame:
    """Rows of the last ``keep`` days; a name stands for the days that its table is kept (RETENTION_DAYS)."""
    days = RETENTION_DAYS[keep] if isinstance(keep, str) else keep
    return df.where(F.col(time) >= as_of - F.make_dt_interval(F.lit(days)))


TABLES = ("feature_vectors", "drift_scores")


def write_scored_windows(vectors: DataFrame, scores: DataFrame, path: str, batch_id: int, **others: DataFrame) -> None:
    """All tables (``feature_vectors``, ``drift_scores`` and ``others`` by name) or none: each batch has a folder of its own in each, and
    readers see it when its commit is written, last.

    A retry overwrites what a failed try has left.
    """
    for name, df in {**dict(zip(TABLES, (vectors, scores), strict=True)), **others}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
    spark = vectors.sparkSession
    spark.range(1).select(F.lit(batch_id).cast("long").alias("committed")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={batch_id}")


def read_scored_windows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table whose batch is committed."""
    commits = spark.read.parquet(f"{path}/commits").select("committed")
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.join(commits, F.col("batch_id") == F.col("committed"), "left_semi").drop("batch_id")


def read_batch_before(spark: SparkSession, path: str, table: str, batch_id: int) -> DataFrame | None:
    """What the last committed batch before this one has left in a table; None if there was none."""
    folder, files = _folder(spark, f"{path}/commits")
    if not files.exists(folder):
        return None
    last = spark.read.parquet(f"{path}/commits").where(F.col("committed") < batch_id).agg(F.max("committed")).first()[0]
    return None if last is None else spark.read.parquet(f"{path}/{table}/batch_id={last}")


def write_baseline(snapshots: DataFrame, path: str) -> None:
    """Append: older snapshots stay as they are, for which one is active follows from time (``read_baselines``)."""
    snapshots.write.mode("append").parquet(path)


def read_baselines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return with_active(reader.parquet(path))


def apply_endpoint_maturity(endpoints: DataFrame, baselines: DataFrame) -> DataFrame:
    """Endpoints with the state of their latest snapshot of any segment; counts and times only move where it has some."""
    last = latest(baselines.select("endpoint_id", "time", F.col("maturity_state").alias("__state"), F.col("sample_count").alias("__count")), ["endpoint_id"])
    rows = endpoints.join(last.withColumnRenamed("time", "__time"), endpoints["id"] == last["endpoint_id"], "left").drop("endpoint_id")
    counted = F.col("__count").isNotNull()
    return rows.withColumns({
        "maturity_state": F.coalesce("__state", "maturity_state"),
        "observation_count": F.coalesce("__count", "observation_count"),
        "last_observed_at": F.when(counted, F.col("__time")).otherwise(F.col("last_observed_at")),
    }).drop("__state", "__count", "__time")
