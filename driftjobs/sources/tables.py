"""Views of the test tables as the monitor's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: From this day on endpoints change, one way each: 0 leaves amounts out, 1 is slower, 2 fails more often, 3 sends nulls
#: and a new field, 4 sends more bytes, 5 no items, 6 numbers for words, 7 numbers among words.
DRIFT_FROM = "2024-01-25"
MOVED = f"ts >= TIMESTAMP '{DRIFT_FROM} 00:00:00'"


def _moved(endpoint: int, also: str = "TRUE") -> str:
    return f"({MOVED} AND user_id % 8 = {endpoint} AND {also})"


OBSERVATIONS = f"""
SELECT ts AS time,
  concat('ep_', CAST(user_id % 8 AS STRING)) AS endpoint_id,
  concat('seg_', CAST(user_id % 3 AS STRING)) AS segmentation_key,
  CAST(event_id AS STRING) AS request_id,
  CASE WHEN {_moved(2, "event_id % 2 = 0")} THEN 503
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN 500 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS status_code,
  CASE WHEN {_moved(1)} THEN 9 ELSE 1 END * CAST(floor(value * 10) AS INT) AS latency_ms,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CASE WHEN {_moved(4)} THEN 9 ELSE 1 END * (CAST(floor(value) AS INT) + 200) END AS response_size_bytes,
  props AS payload_hash,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat(
    '{{"user":{{"id":"u', CAST(user_id % 12 AS STRING), '","vip":', CASE WHEN user_id % 4 = 0 THEN 'true' ELSE 'false' END, '}}',
    ',"kind":', CASE WHEN {_moved(6)} OR {_moved(7, "event_id % 5 = 0")} THEN CAST(event_id % 5 AS STRING) ELSE concat('"', event_type, '"') END,
    CASE WHEN {_moved(0, "event_id % 3 = 0")} THEN '' ELSE concat(',"amount":', CASE WHEN event_id % 13 = 0 OR {_moved(3, "event_id % 2 = 0")} THEN 'null' ELSE CAST(CAST(floor(value) AS INT) AS STRING) END) END,
    CASE WHEN {_moved(5)} THEN '' ELSE concat(',"items":[{{"qty":', CAST(event_id % 5 AS STRING), '}},{{"qty":', CAST(event_id % 7 AS STRING), '}}]') END,
    CASE WHEN event_id % 11 = 0 THEN concat(',"grid":[[', CAST(event_id % 3 AS STRING), '],[1,2,', CAST(event_id % 4 AS STRING), ']]') ELSE '' END,
    CASE WHEN {_moved(3)} THEN ',"debug":true' ELSE '' END, '}}') END AS payload_sample
FROM events
"""

#: What the payloads of OBSERVATIONS hold: a row for each path that occurs and for each value, as flattening gives them.
LEAF_COLUMNS = "endpoint_id, segmentation_key, day, time, request_id"
_SCALARS = ("user.id", "user.vip", "kind", "amount", "debug")
_VISITS = (*[(p, p) for p in _SCALARS], ("user", "user"), ("items", "items"), ("items[]", "items"), ("items[].qty", "items"), ("grid", "grid"), ("grid[]", "grid"))


def _scalar(path: str) -> str:
    kinds = "CASE t WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'int' END"
    number = "CASE t WHEN 'VARCHAR' THEN NULL WHEN 'BOOLEAN' THEN CASE v WHEN 'true' THEN 1.0 ELSE 0.0 END ELSE CAST(v AS DOUBLE) END"
    values = f"SELECT *, json_type(payload_sample, '$.{path}') AS t, json_extract_string(payload_sample, '$.{path}') AS v FROM o"
    return f"UNION ALL SELECT {LEAF_COLUMNS}, '{path}', {kinds}, {number}, CASE t WHEN 'VARCHAR' THEN v END, CASE t WHEN 'VARCHAR' THEN length(v) END FROM ({values}) WHERE t IS NOT NULL"


LEAVES = f"""
{" UNION ALL ".join(f"SELECT {LEAF_COLUMNS}, '{path}' AS path, 'visit' AS kind, CAST(NULL AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BIGINT) AS len FROM o WHERE json_type(payload_sample, '$.{at}') IS NOT NULL" for path, at in _VISITS)}
{" ".join(_scalar(path) for path in _SCALARS)}
UNION ALL SELECT {LEAF_COLUMNS}, 'items[].qty', 'int', CAST(unnest(json_extract_string(payload_sample, '$.items[*].qty')) AS DOUBLE), NULL, NULL FROM o WHERE json_type(payload_sample, '$.items') IS NOT NULL
UNION ALL SELECT {LEAF_COLUMNS}, 'grid[]', 'list', NULL, NULL, n FROM (SELECT *, unnest([json_array_length(payload_sample, '$.grid[0]'), json_array_length(payload_sample, '$.grid[1]')]) AS n FROM o WHERE json_type(payload_sample, '$.grid') IS NOT NULL)
"""

DEPLOYMENTS = "SELECT concat('prj_', CAST(o_custkey % 10 AS STRING)) AS project_id, o_orderdate AS deployed_at FROM orders"
ENDPOINTS = "SELECT concat('ep_', CAST(s_suppkey AS STRING)) AS id, concat('prj_', CAST(s_suppkey % 10 AS STRING)) AS project_id, CASE WHEN s_acctbal < 0 THEN DATE '2024-01-01' END AS deleted_at FROM supplier"
ALERTS = "SELECT CAST(o_orderkey AS STRING) AS id, concat('ep_', CAST(o_custkey AS STRING)) AS endpoint_id, concat('org_', CAST(o_custkey AS STRING)) AS org_id, o_orderstatus AS alert_type, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, o_orderdate AS created_at FROM orders"
SUPPRESSION = "SELECT concat('ep_', CAST(o_custkey AS STRING)) AS endpoint_id, o_orderdate + INTERVAL 1 DAY AS starts_at, o_orderdate + INTERVAL 90 DAY AS ends_at FROM orders WHERE o_orderpriority = '1-URGENT'"
CHANNELS = "SELECT concat('org_', CAST(c_custkey AS STRING)) AS org_id, c_name AS name, CASE WHEN c_nationkey % 2 = 0 THEN 'pagerduty' ELSE 'slack' END AS type, c_acctbal > 9000 AS is_active FROM customer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    """The SQL over one test table."""
    name = f"driftjobs_{source}"
    table(spark, sf_dir, source).createOrReplaceTempView(name)
    return spark.sql(sql.replace(f"FROM {source}", f"FROM {name}"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBSERVATIONS, "events").withColumn("time", F.col("time").cast("timestamp"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DEPLOYMENTS, "orders").withColumn("deployed_at", F.col("deployed_at").cast("timestamp"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ENDPOINTS, "supplier")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ALERTS, "orders").withColumn("created_at", F.col("created_at").cast("timestamp"))


def suppression_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, SUPPRESSION, "orders")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in ("starts_at", "ends_at")})


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CHANNELS, "customer")
