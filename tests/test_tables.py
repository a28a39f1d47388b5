"""Tables by day, sketches, suppression and alert keys, odd rows and JSON."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from driftjobs.functions.payload import MAX_NESTING, _parse, canonicalize, flatten_payload, is_json, read_payload, safe_json
from driftjobs.jobs.batch import BY, extract_features
from driftjobs.operators import alerts, baseline, features, sketches, windows
from driftjobs.operators.joins import asof_join
from driftjobs.operators.keys import join_same
from driftjobs.sources import io
from test_operators import OBS, observations

T0 = dt.datetime(2024, 1, 1)


def files_under(path):
    return sorted(os.path.relpath(f"{d}/{f}", path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_days_are_folders(spark, tmp_path):
    path = f"{tmp_path}/obs"
    obs = observations(spark, 480, step=15).drop("window_start")  # five days
    io.write_by_day(obs, path)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in files_under(path)}
    assert {f.split("/")[0] for f in before} == {f"date=2024-01-0{d}" for d in range(1, 6)}
    io.write_by_day(obs.where(F.to_date("time") == "2024-01-03").limit(7), path)
    after = {f: os.path.getmtime(f"{path}/{f}") for f in files_under(path)}
    same = lambda fs: {f: t for f, t in fs.items() if "01-03" not in f}
    assert same(before) == same(after) and spark.read.parquet(path).where("date = '2024-01-03'").count() == 7
    start, end = (F.lit(f"2024-01-0{d} 06:00:00").cast("timestamp") for d in (2, 4))
    read = io.read_days(spark, path, start, end).where("endpoint_id = 'ep'")
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(read._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(endpoint_id,ep)" in plan
    files = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert read.count() == (96 - 24) + 7 + 25 and {r.f.split("date=")[1][:10] for r in files} == {"2024-01-02", "2024-01-03", "2024-01-04"}
    assert io.drop_old_days(spark, path, 2, dt.datetime(2024, 1, 5, 12)) == ["2024-01-01", "2024-01-02"]
    assert {f.split("/")[0] for f in files_under(path)} == {f"date=2024-01-0{d}" for d in (3, 4, 5)}
    assert io.drop_old_days(spark, path, "feature_vectors" if "feature_vectors" in io.RETENTION_DAYS else 180, dt.datetime(2024, 1, 5)) == []


def test_row_groups_are_skipped(spark, tmp_path):
    """Within a day's files rows lie by key, so a key's statistics leave most row groups out."""
    rows = spark.range(20_000).select((F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 3600)).alias("time"), F.concat(F.lit("ep"), F.lpad((F.col("id") % 50).cast("string"), 2, "0")).alias("endpoint_id"), F.lit("s").alias("segmentation_key"))
    laid = io.partition_by_day(rows.coalesce(1))
    parts = laid.withColumn("p", F.spark_partition_id()).groupBy("endpoint_id").agg(F.countDistinct("p").alias("parts"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.parts == 1 and r.n == 400 for r in parts)
    within = laid.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).groupBy("p", "endpoint_id").agg(F.min("at").alias("a"), F.max("at").alias("z")).collect()
    assert all(r.z - r.a == 399 for r in within)


def test_sketches_add_up(spark):
    draw = random.Random(2)
    rows = [(T0 + dt.timedelta(seconds=draw.randrange(86_400)), draw.choice(["hot", "hot", "hot", None, "rare" if i % 50 == 0 else "hot"]), "s", str(i), draw.choice([200, 500, None]), None if i % 40 == 0 else int(draw.lognormvariate(4, 1)), 1, "h", None) for i in range(30_000)]
    rows += [(T0, "silent", "s", "x", 200, None, 1, "h", None), (None, "hot", "s", "y", 200, 5, 1, "h", None)]
    obs = spark.createDataFrame(rows, OBS)
    quarters = io.written(sketches.sketched(obs))
    days = sketches.rolled_up(sketches.rolled_up(quarters, "1 hour"), "1 day")
    shares = (0.01, 0.5, 0.95, 0.99)
    got = {r.endpoint_id: r for r in days.select("*", sketches.sketch_quantiles("sketch", shares).alias("q"), F.octet_length("sketch").alias("size")).collect()}
    for key in ("hot", None, "rare"):
        own = sorted(r[5] for r in rows if r[1] == key and r[5] is not None and r[0] is not None)
        assert got[key].n == sum(r[1] == key and r[0] is not None for r in rows) and got[key].n_latency == len(own) and got[key].sum_latency == sum(own)
        for share, q in zip(shares, got[key].q, strict=True):
            below, upto = sum(v < q for v in own) / len(own), sum(v <= q for v in own) / len(own)
            assert below - 2 * sketches.rank_error() <= share <= upto + 2 * sketches.rank_error()
    assert got["silent"].q is None and got["silent"].n == 1 and got["hot"].size < 40_000
    assert sketches.rolled_up(quarters.limit(0), "1 day").count() == 0


def test_dyadic_bins(spark):
    draw = random.Random(1)
    spans = [(0, 0), (5, 4), (-7, 9), (-(1 << 28), 1 << 28), (0, 87_659), *[tuple(sorted((draw.randrange(-900, 900), draw.randrange(-900, 900)))) for _ in range(60)]]
    df = spark.createDataFrame(spans, "a long, z long")
    for r in df.select("a", "z", alerts.dyadic_cover(F.col("a"), F.col("z")).alias("bins")).collect():
        assert len(r.bins) <= 60 and (r.z - r.a > 90_000 or len(r.bins) < 40)
        if r.z - r.a < 2000:
            steps = sorted(s for b in r.bins for s in range(b.no << b.level, (b.no + 1) << b.level))
            assert steps == list(range(r.a, r.z + 1))


def test_odd_suppressions(spark):
    day = lambda d: None if d is None else T0 + dt.timedelta(days=d)
    told = [("a", 5, 2), ("b", None, 2), ("c", 2, None), ("d", None, None), (None, 0, 9), ("e", 1, 1), ("f", -3650, 3650), ("f", 1, 2), ("g", None, None)]
    suppression = spark.createDataFrame([(e, day(a), day(z)) for e, a, z in told], "endpoint_id string, starts_at timestamp, ends_at timestamp")
    rows = [(f"{e}{d}", e, day(d), 1) for e in (*"abcdefg", None) for d in (1, 2, 3, None)] + [("a1", "a", day(1), 1)]
    given = spark.createDataFrame(rows, "id string, endpoint_id string, created_at timestamp, hour int")
    kept = sorted(r.id for r in alerts.suppress_alerts(given, suppression).collect())
    gone = {"b1", "b2", "c2", "c3", "e1", "f1", "f2", "f3"}
    assert kept == sorted(i for i, *_ in rows if i not in gone)
    assert alerts.suppress_alerts(given, suppression.limit(0)).count() == len(rows)
    far = spark.createDataFrame([("a", T0, T0 + dt.timedelta(days=365 * 7000))], suppression.schema)
    assert alerts.suppress_alerts(given, far).where("endpoint_id = 'a'").count() == 1


def plain_dedup(rows, life):
    kept, until = [], {}
    for i, kind, at in sorted(rows, key=lambda r: (repr(r[1]), r[2] is not None, r[2] or 0, r[0])):
        if kind not in until or at is not None and (until[kind] is None or at >= until[kind]):
            kept.append(i)
            until[kind] = None if at is None else at + life
    return sorted(kept)


def test_alert_keys_by_sessions(spark):
    """One kind holds nearly all alerts; gaps of just the key's life, and stretches without any alert."""
    draw = random.Random(4)
    rows, at = [], 0
    for i in range(900):
        at += draw.choice([1, 20, 40, 60, 60, 61, 600, 5000])
        rows.append((i, ("e", draw.choice(["k", "k", "k", None])), at))
    rows += [(901, ("z", "k"), None), (902, ("z", "k"), None), (903, ("z", "k"), 7), (904, ("e", "k"), rows[5][2])]
    df = spark.createDataFrame([(i, *k, None if t is None else T0 + dt.timedelta(seconds=t)) for i, k, t in rows], "id long, endpoint_id string, alert_type string, created_at timestamp")
    assert sorted(r.id for r in alerts.dedup_alerts(df, 60).collect()) == plain_dedup(rows, 60)
    sessions = alerts._sessions(df.where("alert_type = 'k' and endpoint_id = 'e'"), 60_000_000, ("endpoint_id", "alert_type"), 24 * 60_000_000)
    biggest = sessions.groupBy("__session").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert biggest[0] < 60 and biggest[1] > 100
    assert alerts.dedup_alerts(df.limit(0), 60).count() == 0


ODD = ['{"a":1}', '{"a":1} x', '{"a":NaN}', '{"a":1,"a":2}', "[" * 600 + "]" * 600, "[" * MAX_NESTING + "]" * MAX_NESTING, '["' + "[" * 700 + '"]', "1], [2", '"a"],["b"', "1,2", '1,"k":2', "", " ", "null", "﻿1", '{"a":"😀"}', '"' + "\\\\" * 100_000 + '"', '{"a":1e999}', '{"a":-Infinity}', "tru", None]


def test_one_rule_for_json(spark):
    """What the JVM takes for JSON Python reads, and what it doesn't is no payload anywhere."""
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, t string")
    out = df.select("i", is_json(F.col("t")).alias("json"), safe_json(F.col("t"), "{}").alias("safe"), read_payload("t")["parsed"].alias("parsed"), flatten_payload("t").alias("leaves"), canonicalize("t")["payload_hash"].alias("hash"), io.malformed(F.col("t")).alias("why"))
    for r in out.collect():
        text = ODD[r.i]
        assert r.json is (None if text is None else r.i in (0, 5, 6, 13, 15, 16, 17))
        assert r.parsed == bool(r.json and text != "null") and (r.leaves is not None) == r.parsed
        assert r.safe == (text if r.json else "{}") and (r.why == "not JSON") == (not r.json)
        assert (r.hash == "74234e98afe7498f") == (not r.parsed) and (not r.json or text == "null" or _parse(text) is not None)


def test_payloads_that_are_no_text(spark):
    df = spark.sql("""SELECT cast(concat(unhex('7B2261223A22'), unhex('61FF62'), unhex('227D')) AS string) AS t""")
    row = df.select(is_json(F.make_valid_utf8("t")).alias("j"), read_payload("t")["leaves"].alias("v"), canonicalize("t")["normalized"].alias("n"), io.malformed(F.col("t")).alias("w")).first()
    assert row.j and row.v[1]["str"] == "a�b" and row.w == "no endpoint"


def test_null_keys_keep_all_they_have(spark):
    obs = observations(spark, 60).withColumn("segmentation_key", F.when(F.col("request_id") < "req_000030", F.lit("default")))
    responses, fields = (df.collect() for df in extract_features(obs))
    by_key = {r.segmentation_key: r for r in responses}
    assert set(by_key) == {None, "default"} and all(r.status_codes and r.payload_entropy > 0 and r.schema_hash for r in by_key.values())
    assert len([f for f in fields if f.segmentation_key is None]) == len([f for f in fields if f.segmentation_key == "default"]) > 3
    chunks = windows.replay_chunks(obs.withColumns({"endpoint_id": F.when(F.col("request_id") > "req_000050", F.col("endpoint_id")), "time": F.when(F.col("request_id") != "req_000010", F.col("time"))}), 10)
    assert chunks.count() == 60 and {r.endpoint_id for r in chunks.collect()} == {None, "ep"}


def test_joins_of_null_keys(spark):
    a = spark.createDataFrame([(1, None, "x"), (None, None, "y"), (2, 2, "z")], "k int, l int, v string")
    b = spark.createDataFrame([(1, None, "p"), (None, None, "q"), (3, None, "r")], "k int, l int, w string")
    got = {how: sorted(map(tuple, join_same(a, b, ["k", "l"], how).collect()), key=repr) for how in ("inner", "left", "full_outer", "left_semi", "left_anti")}
    assert got["inner"] == sorted([(1, None, "x", "p"), (None, None, "y", "q")], key=repr)
    assert (2, 2, "z", None) in got["left"] and (3, None, None, "r") in got["full_outer"] and len(got["full_outer"]) == 4
    assert got["left_anti"] == [(2, 2, "z")] and len(got["left_semi"]) == 2


def test_ties_of_one_time(spark):
    right = spark.createDataFrame([("a", T0, v) for v in (3, 9, 5)] + [("a", T0 + dt.timedelta(hours=1), 1)], "k string, t timestamp, v int")
    left = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(minutes=5)), ("a", T0 + dt.timedelta(days=2))], "k string, at timestamp")
    assert sorted(r.v for r in asof_join(left, right.repartition(3), ["k"], "at", "t", ["v"]).collect()) == [1, 9, 9]
    assert windows.latest(right.where("v <> 1").repartition(3), ["k"], "t").first().v == 9


@pytest.mark.parametrize("far", [0, 10**9])
def test_deviations_of_great_numbers(spark, far):
    values = [far * 1.0e6 + x for x in (1, 2, 4, 8)]
    obs = observations(spark, 4, payload=lambda i, r: {"n": values[i]})
    row = features.field_features(features.count_values(obs, BY), BY).where("path = 'n'").first()
    assert row["std"] == pytest.approx(3.095696, abs=1e-6) if far == 0 else abs(row["std"] - 3.095696) < 0.2


def test_sums_by_day_make_every_baseline(spark):
    """Quarters of twelve days with gaps, null segments and windows without rows of a latency: as a full recompute on every day."""
    draw = random.Random(3)
    rows = []
    for d in range(12):
        for q in sorted(draw.sample(range(96), draw.randrange(0, 9))):
            for k in range(draw.randrange(1, 4)):
                at = T0 + dt.timedelta(days=d, minutes=15 * q + k)
                rows.append((at, draw.choice("ab"), draw.choice(["s", None]), str(len(rows)), 200, draw.choice([None, 7, 900, 31]), draw.choice([None, 5]), draw.choice("hij"), None))
    obs = windows.tumbling_windows(spark.createDataFrame(rows, OBS))
    vectors = io.written(features.response_features(obs, BY))
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 7, 11, 12)], "d date")
    got = {(r.endpoint_id, r.segmentation_key, r.as_of): r for r in baseline.baselines_of_days(io.written(baseline.daily_sums(vectors)), days, 4).collect()}
    seen = 0
    for d in (2, 3, 7, 11, 12):
        end = F.lit(dt.datetime(2024, 1, d, 23, 59)).cast("timestamp")
        start = F.lit(dt.datetime(2024, 1, d) - dt.timedelta(days=4)).cast("timestamp")
        chosen = windows.baseline_vectors(vectors.where(F.col("window_start") >= start), end, 5, most=10**6)
        for r in baseline.baseline_response(baseline.weighted_vectors(chosen)).collect():
            own = got[r.endpoint_id, r.segmentation_key, dt.date(2024, 1, d)]
            assert own.sample_count == r.sample_count and own.baseline_time == r.baseline_time and own.maturity_state == r.maturity_state
            assert [getattr(own, n) for n in (*baseline.RESPONSE, "payload_entropy")] == pytest.approx([getattr(r, n) for n in (*baseline.RESPONSE, "payload_entropy")], abs=1e-4)
            seen += 1
    assert seen == len(got) > 10
