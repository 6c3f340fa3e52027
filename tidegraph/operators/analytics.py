"""Criticality, health, snapshots and counts: plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions.scalar import nearest_rank


def criticality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, score (in-degree times out-degree), in_degree, out_degree of every node, those without edges too."""
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    both = nodes.select("id").join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))
    return both.select("id", (F.col("in_degree") * F.col("out_degree")).cast("double").alias("score"), "in_degree", "out_degree")


def critical_services(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    if k <= 0:
        raise InvalidRequest("k must be positive")
    return criticality(nodes, edges).orderBy(F.desc("score"), "id").limit(k)


def check_window(window_seconds: int, retention_seconds: int, as_of) -> None:
    if as_of is None:
        raise InvalidRequest("as_of is required")
    if window_seconds <= 0:
        raise InvalidRequest("window must be positive")
    if window_seconds > retention_seconds:
        raise InvalidRequest("window exceeds configured retention")


def _measures() -> list[Column]:
    bad = F.avg(F.when(F.col("status") != "ok", 1.0).otherwise(0.0))
    return [F.count(F.lit(1)).alias("sample_count"), bad.alias("error_rate"), nearest_rank("latency_ms", 0.95).cast("int").alias("p95_latency_ms")]


def _recent(samples: DataFrame, as_of: Column, window_seconds: int) -> DataFrame:
    return samples.where(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(window_seconds)))


def samples_of(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", F.explode("samples").alias("s")).select("source", "target", "s.*")


def edge_health(samples: DataFrame, as_of: Column, window_seconds: int) -> DataFrame:
    return _recent(samples, as_of, window_seconds).groupBy("source", "target").agg(*_measures())


def service_health(nodes: DataFrame, samples: DataFrame, as_of: Column, window_seconds: int, service: str | None = None) -> DataFrame:
    """service, sample_count, error_rate, p95_latency_ms over the samples of its edges, a self-loop's once; zeros without samples."""
    recent = _recent(samples, as_of, window_seconds)
    if service is not None:
        recent = recent.where((F.col("source") == service) | (F.col("target") == service))
        nodes = nodes.where(F.col("id") == service)
    out = recent.select(F.col("source").alias("service"), "latency_ms", "status")
    into = recent.where("source <> target").select(F.col("target").alias("service"), "latency_ms", "status")
    found = out.unionByName(into)
    if service is not None:
        found = found.where(F.col("service") == service)
    got = found.groupBy("service").agg(*_measures())
    return nodes.select(F.col("id").alias("service")).join(got, "service", "left").select("service", F.coalesce("sample_count", F.lit(0).cast("bigint")).alias("sample_count"), F.coalesce("error_rate", F.lit(0.0)).alias("error_rate"), F.coalesce("p95_latency_ms", F.lit(0)).alias("p95_latency_ms"))


def tumbling_health(samples: DataFrame, window: str) -> DataFrame:
    """Health of each edge for each tumbling window of event time."""
    return samples.groupBy("source", "target", F.window("ts", window).alias("w")).agg(*_measures()).select("source", "target", F.col("w.start").alias("window_start"), "sample_count", "error_rate", "p95_latency_ms")


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, outgoing: map of target to average), (target, incoming: array of sources)."""
    out = edges.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "rolling_avg_latency_ms")))).alias("outgoing"))
    return out, edges.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("incoming"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).withColumn("edge_count", edges.agg(F.count(F.lit(1)).alias("n")).scalar())


def drop_counters(state: DataFrame) -> DataFrame:
    return state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("stale_obs", "stale_rem", "unknown_rem")))
