"""Structured Streaming: observations to windowed vectors, triggers and persistence, with late and repeated rows handled."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from driftjobs.constants import DELIVERIES, KEY, PERSIST_DOWN, PERSIST_SECONDS, PERSIST_UP, TRIGGER_COUNT, TRIGGER_SECONDS
from driftjobs.jobs.batch import recompute_baselines
from driftjobs.operators.sketches import sketched
from driftjobs.sources.io import go_at_end, malformed, parse_envelopes, shared_folder

DAY_US = PERSIST_SECONDS * 1_000_000


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups in which redelivered entries share a call and a timer.
ENTRY_BUCKETS = 1024


def with_rocks(spark: SparkSession) -> SparkSession:
    """From now on streams of this session keep their state in RocksDB: on the executors' disks, with checkpoints of what has changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def read_observation_stream(spark: SparkSession, source: str, options: Mapping[str, str]) -> DataFrame:
    """Observations from a stream of envelopes (a column ``value``), such as Kafka or text files."""
    return parse_envelopes(spark.readStream.format(source).options(**options).load())


def without_redelivered(obs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each ``request_id`` once within the watermark. Sources deliver at least once; checkpoints do the rest."""
    return obs.withWatermark("time", delay).dropDuplicatesWithinWatermark(["request_id"])


def once_per_window(rows: DataFrame, delay: str = "15 minutes", duration: str = "15 minutes") -> DataFrame:
    """The first row of each key and window within the watermark."""
    marked = rows.withWatermark("time", delay).withColumn("window_start", F.window("time", duration)["start"])
    return marked.dropDuplicatesWithinWatermark([*KEY, "window_start"])


def stream_features(obs: DataFrame, duration: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Response-level statistics of each closed window. State is one row a key and open window: sums and a quantile sketch.

    Rows that come after their window's close are dropped; Spark counts them in the progress of the query.
    """
    own = F.window("time", duration)
    sketch = F.percentile_approx("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(10_000))
    sums = obs.withWatermark("time", delay).groupBy(*KEY, own.alias("w")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("latency_ms").alias("mean"),
        F.stddev_samp("latency_ms").alias("std"),
        sketch.alias("q"),
        F.avg("response_size_bytes").alias("size_mean"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return sums.select(*KEY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sample_count", zero("mean"), zero("std"), *[F.col("q")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))], zero("size_mean"), "errors")


def stream_sketches(obs: DataFrame, by: Sequence[str] = ("endpoint_id",), window: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """``sketched`` over a stream: each closed window's metrics and latency sketch once. ``rolled_up`` makes hours and days of what was written.

    State is one row and one sketch of fixed size a key and open window.
    """
    with_rocks(obs.sparkSession)
    return sketched(obs.withWatermark("time", delay), by, window)


class _Kept(StatefulProcessor):
    """One value for each key, and a timer at which it may go."""

    def __init__(self, schema: str):
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.schema)

    def read(self, otherwise: tuple) -> tuple:
        return tuple(self.value.get()) if self.value.exists() else otherwise

    def keep(self, value: tuple | None, until: int | None = None) -> None:
        """``until`` in microseconds of event time; timers of older values find that they are no longer meant."""
        if value is None:
            self.value.clear()
        else:
            self.value.update(value)
            self.handle.registerTimer(-(-until // 1000))

    def close(self) -> None:
        pass


def sorted_times(batches: Iterator[pd.DataFrame]) -> np.ndarray:
    return np.sort(np.concatenate([batch["at"].to_numpy(np.int64) for batch in batches]))


class _Triggers(_Kept):
    """Rows since the last trigger, and its time. ``timed``: a trigger that only waits for time fires without a row."""

    def __init__(self, count: int, gap: int, timed: bool):
        super().__init__("n long, last long")
        self.count, self.gap, self.timed = count, gap, timed

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.read((0, None))
        times, fired, at = sorted_times(rows), [], 0
        while at < len(times):  # from one trigger to the next
            waits = last is not None and int(times[at]) < last + self.gap
            late = int(np.searchsorted(times, last + self.gap)) if waits else at  # the first row that time is up for
            full = at + max(self.count - n, 1) - 1
            if self.timed and last is not None and (n or late > at) and late <= full and (not waits or late < len(times)):
                fired.append((*key, last + self.gap, n + late - at))
                n, last, at = 0, last + self.gap, late
                continue
            due = min(full, late) if last is not None else at
            if due >= len(times):
                n += len(times) - at
                break
            fired.append((*key, int(times[due]), n + due - at + 1))
            n, last, at = 0, int(times[due]), due + 1
        self.keep((n, last), last + self.gap)
        yield pd.DataFrame(fired, columns=[*KEY, "fired_at", "rows"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.read((0, None))
        fired = []
        if last is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= last + self.gap:
            if n and self.timed:
                last += self.gap
                fired.append((*key, last, n))
                self.keep((0, last), last + self.gap)
            elif not n:  # the next row fires at once, with or without a state
                self.keep(None)
        yield pd.DataFrame(fired, columns=[*KEY, "fired_at", "rows"])


def triggers(obs: DataFrame, count: int = TRIGGER_COUNT, seconds: int = TRIGGER_SECONDS, timed: bool = False, delay: str = "10 minutes") -> DataFrame:
    """When each key is due: at its first row, then after ``count`` rows or ``seconds``, by the rows' own times.

    The count starts anew at each trigger. The monitor looked at the clock when a row came; with ``timed`` time fires by itself,
    for the rows that wait, when the watermark (``delay`` behind the latest row) has passed it. A key for which no rows
    wait has no state once its time is up: its next row is a first one either way. Rows of a micro-batch are taken in order
    of time; later than the watermark they are dropped. Of a key's rows in a micro-batch the times alone are held (8
    bytes each); the source's own limits bound a micro-batch.
    """
    with_rocks(obs.sparkSession)
    rows = obs.withWatermark("time", delay).select(*KEY, "time", F.unix_micros("time").alias("at"))
    out = f"{KEY[0]} string, {KEY[1]} string, fired_at long, rows long"
    found = rows.groupBy(*KEY).transformWithStateInPandas(_Triggers(count, seconds * 1_000_000, timed), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.withColumn("fired_at", F.timestamp_micros("fired_at"))


class _Persistence(_Kept):
    """How many anomalous windows in a row, and when the last of them was."""

    def __init__(self) -> None:
        super().__init__("count long, grew long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        count, grew = self.read((0, None))
        every = pd.concat(list(rows)).sort_values("at")
        met = []
        for at, score in zip(every["at"].tolist(), every["score"].tolist(), strict=True):
            if grew is None or at - grew >= DAY_US:
                count = 0
            met.append((*key, at, score, count))
            if score >= PERSIST_UP:
                count, grew = count + 1, at
            elif score < PERSIST_DOWN:
                count = 0
        self.keep((count, grew) if count else None, grew + DAY_US if count else None)
        yield pd.DataFrame(met, columns=[*KEY, "at", "score", "persistence"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        _, grew = self.read((0, None))
        if grew is not None and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= grew + DAY_US:
            self.keep(None)
        yield pd.DataFrame([], columns=[*KEY, "at", "score", "persistence"])


def persistence(scores: DataFrame, delay: str = "1 hour") -> DataFrame:
    """As ``anomaly_persistence``, over a stream of ``window_start`` and ``score`` by key: what each window meets.

    State is a count and when it last grew. A count of 0 needs no state, and 24 hours after it last grew a
    timer ends a count with its state, so idle keys hold none. Windows later than ``delay`` are dropped.
    """
    with_rocks(scores.sparkSession)
    rows = scores.withWatermark("window_start", delay).select(*KEY, "window_start", F.unix_micros("window_start").alias("at"), F.col("score").cast("double").alias("score"))
    out = f"{KEY[0]} string, {KEY[1]} string, at long, score double, persistence long"
    found = rows.groupBy(*KEY).transformWithStateInPandas(_Persistence(), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select(*KEY, F.timestamp_micros("at").alias("window_start"), "score", "persistence")


class _Deliveries(_Kept):
    """Entries of a bucket that are failing: how often each has, and until when that counts. The value: how many these are, and when (ms) to look for those that may go.

    A good delivery of an entry that isn't failing reads and writes no state of its own.
    """

    OUT = ("original_id", "value", "reason", "delivery_count", "at")

    def __init__(self, most: int, forget: int):
        super().__init__("held long, due long")
        self.most, self.forget = most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.failing = handle.getMapState("failing", "id string", "failed long, until long")

    def known(self, ids: Sequence, held: int) -> dict:
        """What is held of entries: those asked for, or all if these are fewer."""
        if len(ids) < held:
            found = {i: self.failing.getValue((i,)) for i in ids}
            return {i: tuple(v) for i, v in found.items() if v is not None}
        return {i: tuple(v) for (i,), v in self.failing.iterator()} if held else {}

    def hold(self, before: tuple, held: int, due: int) -> None:
        """A bucket has one timer, or none if it holds nothing."""
        if before[1] and (not held or before[1] != due):
            self.handle.deleteTimer(before[1])
        if held and before[1] != due:
            self.handle.registerTimer(due)
        if held and before != (held, due):
            self.value.update((held, due))
        elif before[0] and not held:
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = []
        for batch in rows:
            good = batch["reason"].isna()
            fine = batch[good]
            yield pd.DataFrame({"original_id": fine["id"], "value": fine["value"], "reason": None, "delivery_count": 0, "at": fine["at"]})
            parts.append(batch[["id", "at", "reason"]].assign(value=batch["value"].where(~good, None)))
        every = pd.concat(parts, ignore_index=True)
        before, now = self.read((0, 0)), timerValues.getCurrentWatermarkInMs() * 1000
        known = self.known(every["id"].unique().tolist(), before[0])
        counts = {i: failed for i, (failed, until) in known.items() if until > now}
        told = every[every["id"].isin({*every["id"][every["reason"].notna()], *known})].sort_values("at", kind="stable")
        last, dead = {}, []
        for i, at, value, reason, fails in zip(told["id"], told["at"].tolist(), told["value"], told["reason"], told["reason"].notna(), strict=True):
            failed = counts.get(i, 0) + 1 if fails else 0
            if failed >= self.most:
                dead.append((i, value, reason, failed, at))
                failed = 0
            counts[i], last[i] = failed, at
        until = {i: at + self.forget for i, at in last.items() if counts[i]}
        for i, at in until.items():
            self.failing.updateValue((i,), (counts[i], at))
        ended = [i for i in last if i in known and not counts[i]]
        for i in ended:
            self.failing.removeKey((i,))
        held = before[0] + sum(i not in known for i in until) - len(ended)
        dues = [-(-at // 1000) for at in until.values()] + ([before[1]] if before[1] else [])
        self.hold(before, held, min(dues, default=0))
        yield pd.DataFrame(dead, columns=self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before, now = self.read((0, 0)), timerValues.getCurrentWatermarkInMs() * 1000
        until = {i: at for (i,), (_, at) in self.failing.iterator()}
        left = {i: at for i, at in until.items() if at > now}
        for i in until.keys() - left.keys():
            self.failing.removeKey((i,))
        # What may go meanwhile counts no more; a bucket is looked through 24 times at most while an entry is held.
        self.hold(before, len(left), max(-(-min(left.values(), default=0) // 1000), (now + self.forget // 24) // 1000))
        yield pd.DataFrame([], columns=self.OUT)


def judged_deliveries(deliveries: DataFrame, most: int = DELIVERIES, forget_seconds: int = 86_400, delay: str = "10 minutes", buckets: int = ENTRY_BUCKETS) -> DataFrame:
    """What becomes of entries (``id``, ``value``, ``time`` of delivery) that a source delivers until they are done: good ones, and dead letters.

    An entry that can't be read (``malformed``) waits for its next delivery; the ``most``-th failure makes it a dead letter, with
    ``original_id``, ``reason``, ``delivery_count`` and ``dead_lettered_at``. A good delivery passes at once (no ``reason``) and ends the count.
    State is a number for each entry that is failing; it goes when it is dead or good, or hasn't come again for ``forget_seconds``.

    Entries are dealt into buckets by their hash, and a bucket's rows go to Python together, so the many good ones cost a row each and
    not a call each. Of a bucket's rows in a micro-batch the ids and times are held, and the values of bad ones; of its failing entries
    as many are read as it has rows, at most. A checkpoint belongs to its number of buckets.
    """
    with_rocks(deliveries.sparkSession)
    rows = deliveries.withWatermark("time", delay).select(F.col("id").cast("string").alias("id"), "time", F.unix_micros("time").alias("at"), F.col("value").cast("string").alias("value"))
    rows = rows.withColumns({"reason": malformed(F.col("value")), "value": F.make_valid_utf8("value")})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    out = "original_id string, value string, reason string, delivery_count long, at long"
    found = rows.groupBy("bucket").transformWithStateInPandas(_Deliveries(most, forget_seconds * 1_000_000), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return found.select("original_id", "value", "reason", "delivery_count", F.when(F.col("reason").isNotNull(), F.timestamp_micros("at")).alias("dead_lettered_at"))


def recompute_requested(responses: DataFrame, fields: DataFrame, as_of: Column, write: Callable[[DataFrame, DataFrame, int], None], days: Column | int = 7) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over a stream of requests: recompute the baselines of the keys that a batch names; blank endpoints are skipped."""

    def batch(requests: DataFrame, batch_id: int) -> None:
        keys = requests.where(F.col("endpoint_id") != "").select(*KEY).distinct()
        wanted = lambda df: df.join(keys, list(KEY), "left_semi")
        write(*recompute_baselines(wanted(responses), wanted(fields), as_of, days), batch_id)

    return batch


def replayed(df: DataFrame) -> DataFrame:
    """A table as a stream of its files. They go when the application ends."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    go_at_end(df.sparkSession, path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def in_turn(slices: Iterable[DataFrame], run: Callable[[DataFrame], None]) -> None:
    """Tables that arrive one after the other as files of one stream: ``run`` is given the stream when each has come, to use it up and go on where it ended."""
    path = None
    for df in slices:
        path = path or shared_folder(df.sparkSession)
        df.write.mode("append").parquet(path)
        go_at_end(df.sparkSession, path)
        run(df.sparkSession.readStream.schema(df.schema).parquet(path))


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Give a stream's micro-batches to ``each`` until its source is used up; how many rows were too late. ``checkpoint`` is where it goes on."""
    query = stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _late(query)


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream gives until its source is used up, as a table in the shared folder; ``folder`` goes on where a run before it ended."""
    path = folder or shared_folder(stream.sparkSession)
    go_at_end(stream.sparkSession, path)
    drain(stream, path)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def drain(stream: DataFrame, folder: str) -> int:
    """Run a stream until its source is used up; how many rows were too late."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _late(query)


def _late(query: StreamingQuery) -> int:
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])
