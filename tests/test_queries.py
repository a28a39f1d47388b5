"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from driftjobs.constants import DRIFT_WEIGHTS
from driftjobs.jobs.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Those that between them run every operator; the driver compares all.
CHOSEN = (
    "s1_newest_observations", "s2_envelopes", "s7_quarantine", "s9_day_layout", "p1_safe_json", "w1_tumbling_windows", "w2_replay_chunks", "a0_response_stats",
    "a2_status_distribution", "a5_schema_hash", "a6_field_features", "b4_baseline_fields", "s5_endpoint_maturity", "j1b_baseline_asof", "j2_latest_deployment",
    "f7_confidence", "f9_decisions", "f11_divergences", "f14_test_statistics", "flagship_scored_windows", "c3_replay_windows", "n2_masked_tokens", "n4_payload_hashes",
    "d1_ingestion_metrics", "d2_suppressed_alerts", "d3_distinct_alerts", "x1_triggers", "x3_stream_features", "x4_stream_persistence", "x7_stream_distinct",
    "x_drift_components", "s6_drift_events", "p5_alert_feed", "g1_alert_summaries", "c3_replay_scores", "c3_replay_summary", "a1b_latency_approx", "f17_shannon_entropy", "p9_finite_only", "s2_envelope_stream",
    "p1_one_json_rule", "w2_chunks_of_odd_rows", "a14_vectors_of_null_keys", "d2_odd_suppressions", "s9_days_read_back", "x1_timed_triggers", "x3_stream_sketches",
)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value.replace(tzinfo=None).isoformat() if isinstance(value, dt.datetime) else value


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    found = tables.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    theirs = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in found.fetchall())
    ours = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    assert ours and ours == theirs


def test_every_detector_fires(tables):
    """In the data that the queries are compared on."""
    fired = tables.execute(f"SELECT DISTINCT drift_type, split_part(feature_name, '.', 1) = 'payload' FROM ({ORACLE_SQL['x_drift_components']})").fetchall()
    assert {kind for kind, _ in fired} == set(DRIFT_WEIGHTS) and ("structural_change", True) in fired and ("structural_change", False) in fired


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:3] == ["endpoint_id", "segmentation_key", "day"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_latencies_of_a_hot_window_equal_sql(spark, tmp_path):
    """More distinct latencies in one window than a sketch tells apart."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"""COPY (SELECT range AS event_id, TIMESTAMP '2024-01-05 00:00:00' + to_milliseconds(range) AS ts, CAST(0 AS BIGINT) AS user_id, 'view' AS event_type, (range * 7919 % 200003) / 10.0::DOUBLE AS value, '{{}}' AS props
      FROM range(200000)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = con.execute(f"SELECT endpoint_id, segmentation_key, day, p50, p95, p99 FROM ({ORACLE_SQL['a1b_latency_approx']})").fetchall()
    got = QUERIES["a1b_latency_approx"](spark, str(tmp_path)).select("endpoint_id", "segmentation_key", "day", "p50", "p95", "p99").collect()
    assert [tuple(r) for r in got] == found and len(found) == 1
