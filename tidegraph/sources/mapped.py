"""Dependency events derived from the test tables' `events`. The same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = """
SELECT event_id AS arrival_seq, 'e-' || CAST(event_id AS STRING) AS event_id, ts,
       CASE WHEN event_type IN ('click', 'view', 'purchase', 'error') THEN 'dependency_observed'
            WHEN event_id % 20 < 10 THEN 'heartbeat'
            WHEN event_id % 20 < 16 THEN 'service_metadata'
            ELSE 'dependency_removed' END AS type,
       'svc-' || lpad(CAST(u AS STRING), 5, '0') AS source,
       CASE WHEN k >= 97 AND u % 15 >= 2 AND u % 15 % 4 = 2 THEN 'svc-' || lpad(CAST(u - 2 AS STRING), 5, '0')
            WHEN k % 10 < 3 THEN 'hub-' || CAST(k % 4 AS STRING)
            ELSE 'svc-' || lpad(CAST(u - u % 15 + least(14, u % 15 + 1 + k % 3) AS STRING), 5, '0') END AS target,
       CAST(1 + floor(value) AS INT) AS latency_ms,
       CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 2 = 0 THEN 'error' ELSE 'timeout' END AS status,
       'team-' || CAST(k % 8 AS STRING) AS team, 'tier-' || CAST(k % 2 AS STRING) AS tier, 'region-' || CAST(k % 4 AS STRING) AS region
FROM (SELECT event_id, ts, event_type, value, user_id AS u, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events) x
"""

#: Replays of some events, later and with another latency.
REPLAY_SQL = """
SELECT arrival_seq, event_id, ts, type, source, target, latency_ms, status, team, tier, region FROM dep
UNION ALL
SELECT arrival_seq + 10000000, event_id, ts, type, source, target, latency_ms + 1000, status, team, tier, region FROM dep WHERE arrival_seq % 100 = 7
"""


def _shaped(df: DataFrame) -> DataFrame:
    edge = F.col("type").isin("dependency_observed", "dependency_removed")
    seen = F.col("type") == "dependency_observed"
    return df.select(
        F.col("arrival_seq").cast("bigint").alias("arrival_seq"), "type", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(edge, F.col("source")).alias("source"), F.when(edge, F.col("target")).alias("target"),
        F.when(seen, F.col("latency_ms")).alias("latency_ms"), F.when(seen, F.col("status")).alias("status"), F.when(~edge, F.col("source")).alias("service"),
        F.when(F.col("type") == "service_metadata", F.create_map(F.lit("team"), "team", F.lit("tier"), "tier", F.lit("region"), "region")).alias("attributes"),
    )


def dep_events(spark: SparkSession, sf_dir: str, replays: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dep = spark.sql(SQL.replace("FROM events", "FROM {events}"), events=events)
    return _shaped(spark.sql(REPLAY_SQL.replace("FROM dep", "FROM {dep}"), dep=dep) if replays else dep)
