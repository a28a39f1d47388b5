"""Streams: scores of closed windows with restarts, timers, redelivered entries."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftjobs.constants import KEY
from driftjobs.jobs.batch import BY, extract_features, recompute_baselines, score_batch
from driftjobs.operators import features, windows
from driftjobs.sources import io
from driftjobs.streaming import scoring, streams
from test_operators import OBS

T0 = dt.datetime(2024, 1, 1)


def rows_between(first, last, seed, odd=False):
    """Observations every two minutes of three endpoints; ``odd`` ones are slow and lack a field."""
    draw = random.Random(seed)
    rows = []
    for i in range(first, last):
        for e in range(3):
            payload = '{"a":%d,"s":"%s"%s}' % (draw.randrange(9), draw.choice("xyz"), "" if odd else ',"b":true')
            key = ("ep%d" % e, None if e == 2 else "default")
            rows.append((T0 + dt.timedelta(minutes=2 * i, seconds=e), *key, f"r{i}_{e}", draw.choice((200, 200, 500)), draw.randrange(50, 90) * (8 if odd else 1), 10, draw.choice("hk"), payload))
    return rows


@pytest.fixture(scope="module")
def parts(spark):
    """Two hours to learn from, then three parts of half an hour, the first and last of them odd."""
    past = spark.createDataFrame(rows_between(0, 60, 1), OBS)
    return past, [spark.createDataFrame(rows_between(a, a + 15, a, odd), OBS) for a, odd in ((60, True), (75, False), (90, True))]


@pytest.fixture(scope="module")
def known(spark, parts):
    responses, fields = extract_features(windows.tumbling_windows(parts[0], "15 minutes"))
    base, base_fields = recompute_baselines(responses, fields, F.lit(T0 + dt.timedelta(hours=2)).cast("timestamp"))
    trusted = {"sample_count": F.col("sample_count") * 100, "maturity_state": F.lit("production_trusted"), "window_days": F.lit(14)}
    return base.withColumns(trusted), base_fields


def seen(df):
    rows = df.select(*KEY, "window_start", "sample_count", "score", "severity", "alert_type", "persistence", "confidence_score", "alert_triggered").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_stream_scores_as_batch_does_whatever_fails(spark, parts, known, tmp_path):
    """A batch that fails after its first tables is done again; each part is a run of its own; rows without a segment count."""
    each = scoring.score_closed(f"{tmp_path}/t", lambda _: known)
    tries = []

    def fragile(df, batch_id):
        if not df.isEmpty():
            tries.append(batch_id)
            if len(tries) in (1, 3):
                each(df, batch_id)  # written, but the stream doesn't hear of it
                if len(tries) == 1:
                    spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsparkSession.sessionState().newHadoopConf()).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/t/commits"), True)
                raise RuntimeError("lost")
        each(df, batch_id)

    def run(obs):
        for _ in range(4):
            try:
                return streams.drain_batches(scoring.closed_values(obs, delay="1 minute"), fragile, f"{tmp_path}/s")
            except Exception as e:  # noqa: BLE001
                assert "lost" in str(e)
        raise AssertionError

    streams.in_turn(parts[1], run)
    obs = parts[1][0].union(parts[1][1]).union(parts[1][2])
    closed = windows.tumbling_windows(obs, "15 minutes").where(F.col("window_end") <= F.lit(T0 + dt.timedelta(minutes=209 - 1)).cast("timestamp"))
    responses, fields = extract_features(closed)
    ends = windows.tumbling_windows(closed.drop("window_start", "window_end")).select(*BY, "window_end").distinct()
    expected = score_batch(responses, fields, *known, F.col("window_end"), extra=ends)
    got = io.read_scored_windows(spark, f"{tmp_path}/t", "drift_scores")
    assert seen(got) == seen(expected) and len(seen(got)) == 15 and len(tries) > 3
    assert {r.persistence for r in got.collect()} >= {0, 1} and any(r.alert_triggered for r in got.collect())
    vectors = io.read_scored_windows(spark, f"{tmp_path}/t", "feature_vectors")
    assert vectors.select("endpoint_id", "window_start").distinct().count() == vectors.count() == 15
    events = io.read_scored_windows(spark, f"{tmp_path}/t", "drift_events")
    assert events.count() == got.where("alert_triggered").count() > 0


def test_state_of_fields_equals_a_batch(spark, parts):
    """Counts of a stream that came in parts, and of parts counted apart and summed."""
    found = []
    folder = io.shared_folder(spark)
    streams.in_turn(parts[1], lambda obs: found.append(streams.drained(scoring.closed_values(obs, delay="1 minute"), folder)))
    closed = found[-1].drop("window_end")
    obs = windows.tumbling_windows(parts[1][0].union(parts[1][1]).union(parts[1][2]))
    ended = obs.where(F.col("window_end") <= F.lit(T0 + dt.timedelta(minutes=208)).cast("timestamp"))
    whole = features.counted(features.values_of(ended, BY), BY)
    by_text = lambda df: sorted(map(repr, df.select(*BY, *features.VALUE, "n", "seen").collect()))
    assert by_text(closed) == by_text(whole)
    halves = [features.counted(features.values_of(ended.where(F.crc32(F.col("request_id").cast("binary")) % 2 == k), BY), BY) for k in (0, 1)]
    assert by_text(features.summed(halves[0].union(halves[1]), BY)) == by_text(whole)
    same = lambda df: sorted(map(repr, df.collect()))
    assert same(features.field_features(io.written(closed), BY)) == same(features.field_features(io.written(whole), BY))


def test_a_baseline_is_read_when_windows_close(spark, parts, known, tmp_path):
    """Without one windows score 0 and never alert; it counts from the batch that finds it."""
    asked = []

    def baselines(session):
        asked.append(1)
        return tuple(df.where("endpoint_id = 'ep0'") for df in known) if len(asked) > 1 else tuple(df.limit(0) for df in known)

    each = scoring.score_closed(f"{tmp_path}/t", baselines, recency=lambda w: w.withColumn("deployment_recency_hours", F.lit(0.1)))
    streams.in_turn(parts[1], lambda obs: streams.drain_batches(scoring.closed_values(obs, delay="1 minute"), each, f"{tmp_path}/s"))
    rows = io.read_scored_windows(spark, f"{tmp_path}/t", "drift_scores").orderBy("window_start").collect()
    assert len(asked) >= 3 and {r.score for r in rows if r.endpoint_id != "ep0"} == {0.0} == {r.score for r in rows[:3]}
    assert rows[-1].deployment_recency_hours == 0.1 and any(r.score > 2 for r in rows if r.endpoint_id == "ep0")
    assert all(r.confidence_score is None and not r.alert_triggered for r in rows if r.endpoint_id != "ep0")


def test_persistence_goes_on_from_a_state(spark):
    draw = random.Random(6)
    for trial in range(6):
        times = sorted(draw.sample(range(200), 40))
        rows = [("e", None if trial % 2 else "s", T0 + dt.timedelta(hours=h), float(draw.choice((0, 1.9, 2, 3, 4, 9)))) for h in times]
        df = spark.createDataFrame(rows, "endpoint_id string, segmentation_key string, window_start timestamp, score double")
        whole = {r.window_start: r.persistence for r in windows.anomaly_persistence(df).collect()}
        state, got = None, {}
        for a in range(0, 40, 13):
            part = df.where(F.col("window_start").isin([r[2] for r in rows[a : a + 13]]))
            got |= {r.window_start: r.persistence for r in windows.anomaly_persistence(part, state=state).collect()}
            state = io.written(windows.persistence_state(part, state=state))
        assert got == whole


def plain_triggers(times, count, gap, timed, watermark):
    n, last, out = 0, None, []
    for t in times:
        if timed and n and t >= last + gap:
            out.append((last + gap, n))
            n, last = 0, last + gap
        n += 1
        if last is None or t - last >= gap or n >= count:
            out.append((t, n))
            n, last = 0, t
    if timed and n and last + gap <= watermark:
        out.append((last + gap, n))
    return sorted(out)


@pytest.mark.parametrize("timed", [False, True])
def test_triggers_over_micro_batches(spark, timed):
    """Dense and sparse keys in three runs; by hand with one row at a time. State of idle keys is gone."""
    draw = random.Random(int(timed))
    keys = {"dense": sorted(draw.sample(range(1, 9000), 700)), "sparse": sorted(draw.sample(range(1, 9000), 14)), "early": [5, 6, 7], "one": [3000], "last": [8990, 9000]}
    rows = [(k, "s", dt.datetime.fromtimestamp(t, dt.UTC).replace(tzinfo=None)) for k, ts in keys.items() for t in ts]
    df = spark.createDataFrame(rows, "endpoint_id string, segmentation_key string, time timestamp")
    at = F.unix_seconds("time")
    folder, found = io.shared_folder(spark), []
    streams.in_turn([df.where((at >= a) & (at < a + 3001)) for a in (0, 3001, 6002)], lambda s: found.append(streams.drained(streams.triggers(s, 20, 900, timed, "0 seconds"), folder)))
    got = {k: sorted((int(r.fired_at.timestamp()) if r.fired_at.tzinfo else int(r.fired_at.replace(tzinfo=dt.UTC).timestamp()), r.rows) for r in found[-1].where(F.col("endpoint_id") == k).collect()) for k in keys}
    assert got == {k: plain_triggers(ts, 20, 900, timed, 9000) for k, ts in keys.items()}
    state = spark.read.format("statestore").option("path", f"{folder}/state").option("stateVarName", "value").load()
    held = {r.key.endpoint_id for r in state.collect()}
    assert "last" in held and "one" not in held and ("early" in held) == (not timed)


def test_redelivered_entries(spark):
    good, bad = '{"event_id":"1","payload":{"endpoint_id":"e"}}', "{broken"
    entries = [("good", [good]), ("late good", [bad, bad, good, bad]), ("dead", [bad] * 6), ("waits", [bad] * 4), ("null", [None] * 5), ("nowhere", ['{"payload":{}}'] * 5)]
    rows = [(i, v, T0 + dt.timedelta(minutes=k)) for i, values in entries for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, value string, time timestamp")
    folder, found = io.shared_folder(spark), []
    minute = F.minute("time")
    streams.in_turn([df.where(minute < 2), df.where(minute >= 2)], lambda s: found.append(streams.drained(streams.judged_deliveries(s), folder)))
    got = {(r.original_id, r.reason, r.delivery_count, r.dead_lettered_at is None) for r in found[-1].collect()}
    assert got == {("good", None, 0, True), ("late good", None, 0, True), ("dead", "not JSON", 5, False), ("null", "not JSON", 5, False), ("nowhere", "no endpoint", 5, False)}
    assert isinstance(pd.Timestamp(found[-1].where("original_id = 'dead'").first().dead_lettered_at), pd.Timestamp)


def deliveries(spark, rows):
    return spark.createDataFrame([(i, v, T0 + dt.timedelta(minutes=m)) for i, v, m in rows], "id string, value string, time timestamp")


def judged_in_parts(spark, parts, **options):
    """What comes of deliveries that arrive in parts, each a run of its own."""
    folder, found = io.shared_folder(spark), []
    streams.in_turn([deliveries(spark, rows) for rows in parts], lambda s: found.append(streams.drained(streams.judged_deliveries(s, **options), folder)))
    minutes = (F.unix_seconds("dead_lettered_at") - int(T0.replace(tzinfo=dt.UTC).timestamp())) / 60
    return sorted((tuple(r) for r in found[-1].select("original_id", "value", "reason", "delivery_count", minutes.cast("int")).collect()), key=repr)


def plain_deliveries(rows, most=5):
    failed, out = {}, []
    for i, value, minute in sorted(rows, key=lambda r: r[2]):
        if value is not None and value.startswith("{") and value.endswith("}"):
            failed[i] = 0
            out.append((i, value, None, 0, None))
        else:
            failed[i] = failed.get(i, 0) + 1
            if failed[i] == most:
                out.append((i, value, "not JSON", most, minute))
                failed[i] = 0
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 1024])
def test_many_entries_share_a_bucket(spark, buckets):
    """By hand with one row at a time; few and many rows a part, null ids and values, entries that fail again after their end."""
    draw = random.Random(buckets)
    ids = [None, *(f"e{k}" for k in range(90))]
    values = ('{"payload":{"endpoint_id":"é%d"}}', "{broken %d", "[%d", "퟿%d {", None)
    rows = []
    for minute in range(900):
        v = draw.choices(values, (2, 4, 3, 1, 1))[0]
        rows.append((draw.choice(ids if minute < 880 else ids[:3]), v and (v % minute if "%d" in v else v), minute))
    ends = (700, 880, 900)
    got = judged_in_parts(spark, [[r for r in rows if a <= r[2] < z] for a, z in zip((0, *ends), ends, strict=False)], buckets=buckets)
    expected = plain_deliveries(rows)
    assert got == expected and sum(r[2] is not None for r in expected) > 20


@pytest.mark.parametrize("options", [{}, {"buckets": 1}])
def test_an_entry_is_forgotten_a_day_after_its_last_delivery(spark, options):
    """Not a day after its first one: it came again."""
    good, bad, hour = '{"payload":{"endpoint_id":"e"}}', "{broken", 60
    first = [("again", bad, 0), *(("gone", bad, m) for m in range(4))]
    second = [("again", bad, 20 * hour), ("other", good, 40 * hour)]
    third = [("again", bad, h * hour) for h in (41, 42, 43)] + [("gone", bad, 41 * hour)]
    got = judged_in_parts(spark, [first, second, third], **options)
    assert got == [("again", bad, "not JSON", 5, 43 * hour), ("other", good, None, 0, None)]


def test_good_entries_cost_no_state_each(spark):
    """6000 of them read less of it than one value each."""
    rows = spark.range(6000).select(F.concat(F.lit("e"), "id").alias("id"), F.lit('{"payload":{"endpoint_id":"e"}}').alias("value"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("time"))
    folder = io.shared_folder(spark)
    query = streams.judged_deliveries(streams.replayed(rows)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    reads = sum(op["customMetrics"]["rocksdbGetCount"] for progress in query.recentProgress for op in progress["stateOperators"])
    assert spark.read.parquet(f"{folder}/out").count() == 6000 and reads < 2000
