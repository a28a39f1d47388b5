"""Operators on small tables, with the values that the monitor has always given."""

import datetime as dt
import functools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftjobs.constants import KEY
from driftjobs.jobs.batch import BY, decide, extract_features, recompute_baselines, replay, replay_summary, run_pipeline, score_batch
from driftjobs.operators import alerts, baseline, drift, features, joins, windows
from driftjobs.sources import io
from driftjobs.streaming import streams

T0 = dt.datetime(2024, 1, 1)
LATER = T0 + dt.timedelta(days=1)
OBS = "time timestamp, endpoint_id string, segmentation_key string, request_id string, status_code int, latency_ms int, response_size_bytes int, payload_hash string, payload_sample string"


def observations(spark, n, start=T0, latency=120, payload=None, status=lambda i: 200, step=1, seed=42, hash_=lambda i: f"h{i % 100}", key="ep"):
    draw = random.Random(seed)
    payload = payload or (lambda i, r: {"user": {"id": f"usr_{r.randrange(50)}", "email": f"u{r.randrange(50)}@example.com"}, "items": [{"item_id": "item_1", "price": r.uniform(5, 50)}, {"item_id": "item_2", "price": r.uniform(10, 100)}], "method": "GET" if r.random() < 0.8 else "POST", "active": r.random() < 0.9})
    rows = [(start + dt.timedelta(minutes=step * i), key, "default", f"req_{i:06d}", status(i), max(1, int(draw.gauss(latency, latency / 6))), 1024 + int(draw.gauss(100, 20)), hash_(i), json.dumps(payload(i, draw))) for i in range(n)]
    return spark.createDataFrame(rows, OBS).withColumn("window_start", F.lit(start).cast("timestamp"))


def fields_of(spark, payloads):
    obs = observations(spark, len(payloads), payload=lambda i, r: payloads[i])
    return {r.path: r for r in field_vectors(obs).collect()}


def field_vectors(obs, by=BY, **options):
    return features.field_features(features.count_values(obs, by), by, **options)


def response_vectors(obs, by=BY):
    own = features.response_features(obs, by)
    assert sorted(map(repr, own.collect())) == sorted(map(repr, features.response_features(obs, by, features.count_values(obs, by)).collect()))
    return own


def test_response_level(spark):
    obs = observations(spark, 100, status=lambda i: 200 if i < 80 else 404 if i < 90 else 500, hash_=lambda i: f"h{i % 16}")
    row = response_vectors(obs, BY).first()
    assert row.status_codes == {"200": 0.8, "404": 0.1, "500": 0.1} and row.sample_count == 100
    assert features.payload_entropy(observations(spark, 96, hash_=lambda i: f"h{i % 16}"), BY).first().payload_entropy == 4.0
    assert row.schema_version == f"v:{row.schema_hash[:8]}"
    same = features.payload_entropy(observations(spark, 9, hash_=lambda i: "x" if i else ""), BY).first()
    assert same.payload_entropy == 0.0
    one = features.response_stats(observations(spark, 1), BY).first()
    assert one.std == 0.0 and one.p50 == one.p99 == one.mean


def test_empty_columns(spark):
    obs = observations(spark, 3).withColumns({c: F.lit(None).cast(t) for c, t in (("latency_ms", "int"), ("response_size_bytes", "int"), ("payload_hash", "string"), ("payload_sample", "string"), ("status_code", "int"))})
    row = response_vectors(obs, BY).first()
    assert (row.p95, row.mean, row.std, row.size_p95, row.payload_entropy, row.status_codes, row.schema_hash) == (0, 0, 0, 0, 0, {}, None)
    assert field_vectors(obs).count() == 0


def test_field_types(spark):
    f = fields_of(spark, [{"v": 10 * (i + 1), "s": "active" if i % 2 else "inactive", "b": i < 70, "n": None if i < 30 else "x", "m": "t" if i < 70 else 1} | ({"p": 1} if i < 60 else {}) for i in range(100)])
    assert (f["v"].mean, f["v"].min_val, f["v"].max_val, f["v"].dominant_type) == (505, 10, 1000, "number")
    assert (f["s"].vocabulary_size, f["s"].vocabulary_entropy, f["s"].enum_distribution) == (2, 1.0, {"active": 0.5, "inactive": 0.5})
    assert f["b"].mean == 0.7 and f["b"].std is None and f["n"].null_rate == 0.3
    assert f["m"].dominant_type == "string" and f["m"].type_consistency == 0.7 and f["p"].presence_rate == 0.6


def test_enum_threshold_and_ties(spark):
    f = fields_of(spark, [{"few": f"v{i % 10}", "many": f"v{i % 60}", "tie": 1 if i % 2 else "a", "nul": None} for i in range(120)])
    assert len(f["few"].enum_distribution) == 10 and f["many"].enum_distribution is None and f["many"].vocabulary_size == 60
    assert f["tie"].dominant_type == "number"  # the newest row is seen first
    assert f["nul"].dominant_type == "null" and f["nul"].type_consistency == 0


def test_field_cap(spark):
    obs = observations(spark, 2, payload=lambda i, r: {f"k{j:03d}": 1 for j in range(600 if i else 550)})
    assert field_vectors(obs).count() == 500
    assert field_vectors(obs, most=10).select("path").orderBy("path").first().path == "k000"


def test_chunks_and_numbering(spark):
    chunks = windows.replay_chunks(observations(spark, 250, step=60))
    assert [r["count"] for r in chunks.groupBy("chunk").count().orderBy("chunk").collect()] == [100, 100, 50]
    assert windows.replay_chunks(observations(spark, 7)).select("chunk").distinct().count() == 1


def persistence_of(spark, scores):
    rows = [("a", "d", T0 + dt.timedelta(hours=h), float(s)) for h, s in scores]
    df = spark.createDataFrame(rows, "endpoint_id string, segmentation_key string, window_start timestamp, score double")
    return df, [r.persistence for r in windows.anomaly_persistence(df).orderBy("window_start").collect()]


@pytest.mark.parametrize(("scores", "expected"), [([(0, 5), (1, 5), (2, 1), (3, 5)], [0, 1, 2, 0]), ([(0, 5), (1, 3), (2, 5)], [0, 1, 1]), ([(0, 5), (25, 5), (26, 5)], [0, 0, 1])])
def test_persistence(spark, scores, expected):
    assert persistence_of(spark, scores)[1] == expected


def test_persistence_stream_equals_batch(spark):
    draw = random.Random(3)
    scores = [(h * draw.choice([1, 1, 7]), draw.choice([1, 3, 5, 6])) for h in range(120)]
    df, batch = persistence_of(spark, sorted({h: s for h, s in scores}.items()))
    stream = streams.drained(streams.persistence(streams.replayed(df)))
    assert [r.persistence for r in stream.orderBy("window_start").collect()] == batch


def test_asof_join(spark):
    draw = random.Random(3)
    hour = lambda h: None if h is None else T0 + dt.timedelta(hours=h)
    left = [(i, draw.choice(["a", "b", "c", None]), draw.choice([None, *range(0, 200, 7)])) for i in range(300)]
    right = [(draw.choice(["a", "b", None]), h, f"v{h}") for h in [None, *draw.sample(range(0, 220), 40)]]
    rows = joins.asof_join(
        spark.createDataFrame([(i, k, hour(h)) for i, k, h in left], "i int, k string, t timestamp"),
        spark.createDataFrame([(k, hour(h), v) for k, h, v in right], "k string, u timestamp, v string"), ["k"], "t", "u", ["v"],
    )
    best = lambda k, h: max(((u, v) for own, u, v in right if own == k and k is not None and u is not None and h is not None and u <= h), default=(None, None))[1]
    assert {r.i: r.v for r in rows.collect()} == {i: best(k, h) for i, k, h in left} and rows.count() == 300


def built(spark, before, after):
    """Baseline of ``before``, and vectors of ``after``, a day later."""
    responses, fields = extract_features(before)
    return *extract_features(after), *recompute_baselines(responses, fields, F.lit(LATER).cast("timestamp"))


CHANGES = {
    "same": ({"seed": 7}, None, 0.0, 3.0),
    "slow": ({"latency": 500}, "latency_shift", 4.0, 10.0),
    "nulls": ({"payload": lambda i, r: {"method": "GET", "user": {"email": None if i % 5 < 3 else "u@example.com", "id": f"usr_{r.randrange(50)}"}, "active": True, "items": [{"item_id": "item_1", "price": 20.0}]}}, "null_rate_spike", 1.0, 10.0),
    "new": ({"payload": lambda i, r: {"debug_flag": True}}, "structural_change", 1.0, 10.0),
    "gone": ({"payload": lambda i, r: {"debug_flag": True}}, "field_disappeared", 1.0, 10.0),
    "errors": ({"status": lambda i: 500 if i % 2 else 200}, "status_code_shift", 4.0, 10.0),
    "flat": ({"hash_": lambda i: "one"}, "payload_entropy_drop", 2.0, 10.0),
    "types": ({"payload": lambda i, r: {"method": 7, "active": "no", "user": {"id": "x", "email": "y"}, "items": [{"item_id": "z", "price": 1.0}]}}, "schema_type_change", 2.0, 10.0),
}


def test_detectors_end_to_end(spark):
    """One endpoint for each change, all in one job."""
    union = lambda frames: functools.reduce(lambda a, b: a.union(b), frames)
    before = union([observations(spark, 300, key=k) for k in CHANGES])
    after = union([observations(spark, 100, start=LATER, key=k, **change) for k, (change, *_) in CHANGES.items()])
    responses, fields, base, base_fields = built(spark, before, after)
    kinds = {}
    for c in drift.drift_components(responses, fields, base, base_fields, BY).collect():
        kinds.setdefault(c.endpoint_id, set()).add(c.drift_type)
    scores = {r.endpoint_id: r.score for r in drift.score_drift(responses, fields, base, base_fields, BY).collect()}
    for k, (_, kind, least, most) in CHANGES.items():
        assert least <= scores[k] <= most, k
        assert kind is None or kind in kinds[k], k


def test_disappeared_field_and_quiet_windows(spark):
    responses, fields, base, base_fields = built(spark, observations(spark, 50), observations(spark, 20, start=LATER, seed=42))
    nothing = fields.where("false")
    gone = drift.drift_components(responses, nothing, base, base_fields, BY).where("drift_type = 'field_disappeared'").collect()
    assert {c.feature_name for c in gone} >= {"field.user.id", "field.active"} and all((c.deviation_z, c.weight) == (5.0, 2.0) for c in gone)
    alone = drift.score_drift(responses, fields, base.where("false"), base_fields.where("false"), BY).first()
    assert (alone.score, alone.severity, alone.summary) == (0.0, None, "No significant behavioral drift detected.")


@pytest.mark.parametrize(("parts", "expected"), [([(3, 0.8), (5, 1.5)], 9.9 / 2.3), ([(2.5, 0.8), (4, 1.5), (5, 2)], 18 / 4.3), ([(10, 2)], 10.0)])
def test_weighted_score(spark, parts, expected):
    rows = [("e", "s", T0, i, f"f{i}", "latency_shift", 0.0, 0.0, float(z), 0.0, float(w)) for i, (z, w) in enumerate(parts)]
    df = spark.createDataFrame(rows, "endpoint_id string, segmentation_key string, window_start timestamp, place int, feature_name string, drift_type string, baseline_value double, observed_value double, deviation_z double, deviation_pct double, weight double")
    assert drift.drift_total(df, BY).first().score == pytest.approx(expected, abs=1e-4)


def test_baseline_weights(spark):
    days = [observations(spark, n, start=T0 + dt.timedelta(days=d), latency=lat) for d, (n, lat) in enumerate([(100, 100), (100, 200)])]
    obs = days[0].union(days[1])
    vectors = windows.baseline_vectors(response_vectors(obs, BY), F.lit(T0 + dt.timedelta(days=2)).cast("timestamp"))
    means = {r.age: r.mean for r in vectors.collect()}
    row = baseline.baseline_response(baseline.weighted_vectors(vectors)).first()
    assert row.mean == pytest.approx((means[0] + 0.9 * means[1]) / 1.9) and (row.sample_count, row.maturity_state) == (200, "learning")


def test_replay_and_decision(spark):
    past = observations(spark, 300).drop("window_start").withColumn("window_start", F.lit(T0).cast("timestamp"))
    by = ["endpoint_id", "window_start"]
    vectors = windows.baseline_vectors(response_vectors(past, by), F.lit(LATER).cast("timestamp"), by=["endpoint_id"])
    base, base_fields = baseline.compute_baseline(vectors, field_vectors(past, by), ["endpoint_id"])
    rows = replay(observations(spark, 250, start=LATER).drop("window_start"), base, base_fields, F.lit(LATER).cast("timestamp"))
    assert sorted(r.sample_count for r in rows.collect()) == [50, 100, 100]
    summary = replay_summary(rows).first()
    assert summary.windows == 3 and summary.observations == 250


def test_recent_deployment_lowers_confidence(spark):
    responses, fields, base, base_fields = built(spark, observations(spark, 500), observations(spark, 100, start=LATER))
    now = F.lit(LATER).cast("timestamp")
    plain = score_batch(responses, fields, base, base_fields, now).first()
    fresh = score_batch(responses, fields, base, base_fields, now, F.lit(0.1)).first()
    assert fresh.confidence_score < plain.confidence_score
    scored = drift.score_drift(responses, fields, base, base_fields, BY).withColumns({"persistence": F.lit(0), "deployment_recency_hours": F.lit(0.1)})
    assert decide(scored, base, now).first().confidence_score == fresh.confidence_score


def test_sources(spark, tmp_path):
    good = json.dumps({"event_id": "1", "timestamp": "2024-01-01T00:00:00Z", "payload": {"endpoint_id": "e", "latency_ms": 3, "status_code": 200}})
    raw = spark.createDataFrame([(good,), ("{",), ('{"event_id":"2"}',), (None,)], "value string")
    rows, bad = io.split_malformed(raw, F.lit(T0).cast("timestamp"))
    assert [r.segmentation_key for r in io.parse_envelopes(rows).collect()] == ["default"]
    assert sorted(r.reason for r in bad.collect()) == ["no endpoint", "not JSON", "not JSON"]
    for batch in (0, 0):
        io.write_scored_windows(rows, rows, f"{tmp_path}/w", batch)
    rows.write.parquet(f"{tmp_path}/w/feature_vectors/batch_id=1")  # a batch that failed before its scores
    assert [io.read_scored_windows(spark, f"{tmp_path}/w", t).count() for t in io.TABLES] == [1, 1]
    snaps = spark.createDataFrame([("e", "s", T0, 1), ("e", "s", LATER, 2)], "endpoint_id string, segmentation_key string, time timestamp, n int")
    io.write_baseline(snaps, f"{tmp_path}/b")
    assert [(r.n, r.is_active) for r in io.read_baselines(spark, f"{tmp_path}/b").orderBy("n").collect()] == [(1, False), (2, True)]
    obs = observations(spark, 5)
    both = obs.union(observations(spark, 3, start=LATER))
    io.partition_by_day(both).write.partitionBy("date").parquet(f"{tmp_path}/days")
    laid = spark.read.parquet(f"{tmp_path}/days").where(F.col("date") == F.lit(LATER.date()))
    assert laid.count() == 3 and len(laid.inputFiles()) == 2 and "PartitionFilters: [isnotnull(date" in laid._jdf.queryExecution().executedPlan().toString()
    as_of = F.lit(T0 + dt.timedelta(days=90, minutes=2)).cast("timestamp")
    assert io.apply_retention(both, "observations", as_of).count() == 6 and io.apply_retention(both, 1000, as_of).count() == 8
    with pytest.raises(KeyError):
        io.apply_retention(both, "no such table", as_of)
    inside = io.read_observations(obs, F.lit(T0).cast("timestamp"), F.lit(T0 + dt.timedelta(minutes=2)).cast("timestamp"))
    assert inside.count() == 3 and io.read_observations(obs, F.lit(T0).cast("timestamp"), F.lit(LATER).cast("timestamp"), 2).count() == 2


def test_no_shared_folder_is_an_error_on_a_cluster():
    class Context:
        applicationId = "app"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default: default)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        Context.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            io.shared_folder(Session)
    for master in ("local", "local[8]", "local[*]"):
        Context.master = master
        assert io.shared_folder(Session) != io.shared_folder(Session)


def test_alert_tables(spark):
    at = lambda *hours: [T0 + dt.timedelta(hours=h) for h in hours]
    rows = spark.createDataFrame([(str(i), "e", "o", "latency_shift", "high", t) for i, t in enumerate(at(0, 0.5, 2, 30))], "id string, endpoint_id string, org_id string, alert_type string, severity string, created_at timestamp")
    assert [r.id for r in alerts.dedup_alerts(rows).orderBy("id").collect()] == ["0", "2", "3"]
    chain = spark.createDataFrame([(f"{kind}{i}", kind, t) for kind in "ab" for i, t in enumerate(at(*[k * 2 / 3 for k in range(5)]))], "id string, kind string, created_at timestamp")
    assert [r.id for r in alerts.dedup_alerts(chain, 3600, ["kind"]).orderBy("id").collect()] == ["a0", "a2", "a4", "b0", "b2", "b4"]  # every 40 minutes
    quiet = spark.createDataFrame([("e", *at(0.5, 2))], "endpoint_id string, starts_at timestamp, ends_at timestamp")
    assert [r.id for r in alerts.suppress_alerts(rows, quiet).orderBy("id").collect()] == ["0", "3"]
    channels = spark.createDataFrame([("o", "a", "pagerduty", True), ("o", "b", "slack", True), ("o", "c", "slack", False)], "org_id string, name string, type string, is_active boolean")
    assert sorted({(r.channel, r.channel_severity) for r in alerts.route_alerts(rows, channels).collect()}) == [("a", "error"), ("b", "high")]


def test_baseline_requests(spark, tmp_path):
    """A stream of requests: what a batch names is recomputed, blank endpoints and keys without vectors give nothing."""
    responses, fields = extract_features(observations(spark, 200))
    got = []
    run = streams.recompute_requested(responses, fields, F.lit(LATER).cast("timestamp"), lambda base, _, batch: got.append((batch, base.count())))
    requests = spark.createDataFrame([("ep", "default"), ("ep", "default"), ("", "default"), ("other", "default")], "endpoint_id string, segmentation_key string")
    requests.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert got == [(0, 1)] and set(KEY) <= set(responses.columns)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Envelopes as a stream of text: a row after its window's close is dropped, one before it counts."""
    line = lambda i, minute: json.dumps({"event_id": str(i), "timestamp": (T0 + dt.timedelta(minutes=minute)).isoformat() + "Z", "payload": {"endpoint_id": "e", "request_id": str(i), "latency_ms": 5, "status_code": 200}})
    stream = lambda: streams.stream_features(streams.read_observation_stream(spark, "text", {"path": f"{tmp_path}/in"}))
    late = []
    for batch in ([1, 2, 14, 29], [16, 45], [3, 46], [90]):
        spark.createDataFrame([(line(100 * len(late) + m, m),) for m in batch], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        late.append(streams.drain(stream(), f"{tmp_path}/run"))
    assert late == [0, 0, 1, 0]
    rows = spark.read.parquet(f"{tmp_path}/run/out").orderBy("window_start").collect()
    assert [(r.window_start.minute, r.sample_count) for r in rows] == [(0, 3), (15, 2), (45, 2)]


def test_persistence_state_goes_after_a_day(spark, tmp_path):
    draw = random.Random(5)
    scores = [(h, draw.choice([1.0, 3.0, 5.0])) for h in range(0, 400, 3)]
    df, batch = persistence_of(spark, scores)
    for k in range(0, len(scores), 45):  # four runs, in order of time
        part = df.where(F.col("window_start").between(F.lit(T0 + dt.timedelta(hours=scores[k][0])), F.lit(T0 + dt.timedelta(hours=scores[min(k + 44, len(scores) - 1)][0]))))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streams.drained(streams.persistence(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/run")
    assert [r.persistence for r in out.orderBy("window_start").collect()] == batch
    far = spark.createDataFrame([("other", "d", T0 + dt.timedelta(days=90), 1.0)], df.schema)
    for day in (0, 1):
        far.withColumn("window_start", F.col("window_start") + F.make_dt_interval(F.lit(day))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.drain(streams.persistence(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/run")
    assert spark.read.format("statestore").option("stateVarName", "value").load(f"{tmp_path}/run/state").count() == 0


def test_six_detectors_by_hand(spark):
    """Size, schema hash, type consistency and presence on small vectors, just over and just under what makes them fire."""
    cases = {"size": ({"size_mean": 1300.0}, {"size_mean": 1000.0, "size_std": 100.0}, (3.0, 30.0)), "calm": ({"size_mean": 1190.0}, {"size_mean": 1000.0, "size_std": 100.0}, None), "hash": ({"schema_hash": "b"}, {"schema_hash": "a"}, (4.0, 100.0)), "same": ({"schema_hash": "a"}, {"schema_hash": "a"}, None), "none": ({"schema_hash": "a"}, {"schema_hash": None}, None)}
    level = {"p95": 0.0, "mean": 0.0, "std": 0.0, "size_mean": 0.0, "size_std": 0.0, "payload_entropy": 0.0, "schema_hash": None}
    kind = "struct<" + ",".join(f"{k}:{'string' if k == 'schema_hash' else 'double'}" for k in level) + ">"
    rows = spark.createDataFrame([(k, tuple((level | c).values()), tuple((level | b).values())) for k, (c, b, _) in cases.items()], f"k string, c {kind}, b {kind}")
    got = {r.k: (r.deviation_z, r.deviation_pct) for r in drift.response_components(rows, ["k"]).collect()}
    assert got == {k: x for k, (*_, x) in cases.items() if x}
    field = {"presence_rate": 1.0, "null_rate": 0.0, "type_consistency": 1.0, "dominant_type": "string", "mean": None, "std": None, "vocabulary_size": None, "vocabulary_entropy": None, "enum_distribution": None}
    cases = {
        "mixed": ({"type_consistency": 0.9}, {}, ("type_consistency_drop", 10.0)), "steady": ({"type_consistency": 0.95}, {}, None), "loose": ({"type_consistency": 0.5}, {"type_consistency": 0.95}, None),
        "rare": ({"presence_rate": 0.5}, {"presence_rate": 0.8}, ("presence_rate_drop", -7.5)), "seldom": ({"presence_rate": 0.1}, {"presence_rate": 0.5}, None), "typed": ({"dominant_type": "number"}, {}, ("schema_type_change", 5.0)), "null": ({"dominant_type": "null"}, {}, None),
    }
    kind = "struct<presence_rate:double,null_rate:double,type_consistency:double,dominant_type:string,mean:double,std:double,vocabulary_size:int,vocabulary_entropy:double,enum_distribution:map<string,double>>"
    rows = spark.createDataFrame([(k, k, 100, tuple((field | c).values()), tuple((field | b).values())) for k, (c, b, _) in cases.items()], f"k string, path string, sample_count int, c {kind}, b {kind}")
    got = {r.k: (r.drift_type, r.deviation_z) for r in drift.field_components(rows, ["k"]).collect()}
    assert got == {k: x for k, (*_, x) in cases.items() if x}


def test_events_hold_the_contract(spark):
    found = "array<struct<place:int,feature_name:string,drift_type:string,baseline_value:double,observed_value:double,deviation_z:double,deviation_pct:double,weight:double>>"
    schema = f"endpoint_id string, segmentation_key string, window_start timestamp, score double, severity string, alert_type string, confidence_score double, confidence_level string, alert_triggered boolean, baseline_time timestamp, model_version string, summary string, found {found}"
    part = (1, "latency.p95", "latency_shift", 1.0, 2.0, 5.0, 100.0, 0.8)
    rows = spark.createDataFrame([("e", "s", T0, 5.1234, "medium", "latency_shift", 0.85, "high", True, T0, "1.0.0", "text", [part]), ("e", "s", T0, 2.0, None, None, None, None, True, None, "1.0.0", "text", None), ("e", "s", T0, 9.0, None, None, None, None, False, None, "1.0.0", "text", None)], schema)
    events = alerts.to_drift_events(rows.withColumn("org_id", F.lit("org")))
    first, second = events.orderBy(F.desc("drift_score")).collect()
    assert set(events.columns) == {"endpoint_id", "segmentation_key", "org_id", "project_id", "drift_score", "confidence_score", "confidence_state", "severity", "alert_type", "model_version", "timestamp", "baseline_snapshot_time", "summary", "components"} and {t for _, t in events.dtypes} == {"string"}
    assert (first.drift_score, first.confidence_score, first.confidence_state, first.org_id, first.project_id) == ("5.1234", "0.85", "high", "org", "")
    assert json.loads(first.components) == [dict(zip(alerts.PARTS, part[1:], strict=True))]
    assert (second.severity, second.alert_type, second.baseline_snapshot_time, second.components, second.confidence_state) == ("low", "behavioral_drift", "", "[]", "low")
    assert [r.asDict() for r in alerts.drift_feed(events).where("severity = 'medium'").collect()] == [{"endpoint_id": "e", "drift_score": 5.1234, "severity": "medium", "alert_type": "latency_shift", "confidence": "high", "timestamp": "2024-01-01 00:00:00"}]
    assert alerts.alert_feed(events).columns == ["endpoint_id", "drift_score", "severity", "alert_type", "summary", "timestamp"] and alerts.alert_feed(events).count() == 0


def test_quantiles_and_lists(spark):
    draw = random.Random(2)
    values = {k: [draw.choice([None, 1.5, 2, draw.randrange(50)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 57), ("d", 400))} | {"none": [None]}
    df = spark.createDataFrame([(k, float(v) if v is not None else None) for k, own in values.items() for v in own], "k string, v double")
    got = {r.k: r.q for r in features.quantiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    own = {k: [v for v in x if v is not None] for k, x in values.items()}
    assert got == {k: pytest.approx(np.quantile(v, (0.0, 0.25, 0.5, 0.99, 1.0)).tolist()) for k, v in own.items() if v}
    f = fields_of(spark, [{"grid": [[1] * (i % 4), [2, 3]]} for i in range(20)])["grid[]"]
    lengths = [n for i in range(20) for n in (i % 4, 2)]
    assert (f.dominant_type, f.mean, f.vocabulary_size) == ("array", None, None) and f.mean_length == pytest.approx(np.mean(lengths)) and f.std_length == pytest.approx(np.std(lengths, ddof=1), abs=1e-6)


def test_a_cap_that_is_given_is_kept(spark, monkeypatch):
    obs = observations(spark, 1500, step=0).drop("window_start")
    split, now = F.lit(T0).cast("timestamp"), F.lit(LATER).cast("timestamp")
    assert [run_pipeline(obs, split, now, max_per_window=n).first().sample_count for n in (None, 1200, 100)] == [1500, 1200, 100]


@pytest.mark.parametrize("accuracy", [2, 50, 10_000])
def test_ranked_latencies_whatever_the_sketch(spark, accuracy):
    """By hand, also from sketches that are far off; null keys, few rows, equal rows, ranks that are whole numbers, groups without latencies."""
    draw = random.Random(accuracy)
    groups = {("a", None): [draw.random() for _ in range(3001)], (None, 1): [5.0], ("b", 1): [7.5] * 100, (None, None): [float(draw.randrange(-9, 9)) for _ in range(700)], ("c", 2): [], ("c", 3): [1.0, 2.0]}
    rows = [(*key, v) for key, values in groups.items() for v in [*values, None]]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, w int, latency_ms double").repartition(5)
    got = {(r.k, r.w): (r.p50, r.p95, r.p99) for r in features.latency_stats_ranked(df, ("k", "w"), accuracy).collect()}
    assert got == {key: tuple(sorted(values)[max(-(-len(values) * s // 100), 1) - 1] for s in (50, 95, 99)) for key, values in groups.items() if values}
