"""The engine: state and the six questions that it answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import HealthConfig
from .errors import UnknownService
from .operators import analytics
from .operators.ingest import edge_state, first_arrivals, live_edges, merge_nodes
from .plans import traversal
from .sources.decode import read_batch
from .sources.store import State, Store


class Engine:
    def __init__(self, spark: SparkSession, state: State, health: HealthConfig = HealthConfig()):
        self.spark, self.state, self.health_config = spark, state, health
        self.nodes, self.edges = state.nodes, live_edges(state.edge_state)
        self.topology = self.edges.drop("samples")

    @classmethod
    def from_events(cls, spark: SparkSession, events: DataFrame, health: HealthConfig = HealthConfig(), oldest=None) -> Engine:
        first = first_arrivals(events)
        state = edge_state(first, None, health.max_samples_per_edge, oldest)
        return cls(spark, State(merge_nodes(first, state), state, first.select("event_id")), health)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str, **kw) -> Engine:
        return cls.from_events(spark, read_batch(spark, text), **kw)

    @classmethod
    def from_store(cls, store: Store, health: HealthConfig = HealthConfig()) -> Engine:
        return cls(store.spark, store.load(), health)

    def has_node(self, service: str) -> bool:
        return not self.nodes.where(F.col("id") == service).limit(1).isEmpty()

    def _known(self, *services: str) -> None:
        for s in services:
            if not self.has_node(s):
                raise UnknownService(s)

    def _one(self, service: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(service).alias("id"))

    def reachable(self, service: str) -> DataFrame:
        self._known(service)
        return traversal.reachable(self.topology, self._one(service)).select(F.col("start").alias("service"), "id", "path").orderBy(F.size("path"), "id")

    def dependents(self, service: str) -> DataFrame:
        self._known(service)
        return traversal.reachable(self.topology, self._one(service), reverse=True).select(F.col("start").alias("service"), "id", "path").orderBy(F.size("path"), "id")

    def shortest_path(self, source: str, target: str) -> DataFrame:
        """One row: source, target, found, path, total_latency_ms."""
        self._known(source, target)
        found = traversal.shortest_paths(self.topology, self._one(source), target).where(F.col("id") == target)
        row = self.spark.range(1).select(F.lit(target).alias("id")).join(found, "id", "left")
        return row.select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.col("path").isNotNull().alias("found"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("distance", F.lit(0.0)).alias("total_latency_ms"))

    def critical_services(self, k: int = 10) -> DataFrame:
        return analytics.critical_services(self.nodes, self.topology, k)

    def cycles(self) -> DataFrame:
        return traversal.ordered_cycles(traversal.cycles(self.topology))

    def health(self, service: str, as_of: dt.datetime, window_seconds: int | None = None) -> DataFrame:
        """One row: service, window_seconds, sample_count, error_rate, p95_latency_ms."""
        self._known(service)
        window = self.health_config.window_seconds if window_seconds is None else window_seconds
        analytics.check_window(window, self.health_config.window_seconds, as_of)
        found = analytics.service_health(self.nodes, analytics.samples_of(self.edges), F.lit(as_of), window, service)
        return found.withColumn("window_seconds", F.lit(window))

    def counts(self) -> DataFrame:
        return analytics.graph_counts(self.nodes, self.topology)

    def drop_counters(self) -> DataFrame:
        return analytics.drop_counters(self.state.edge_state)

    def adjacency(self) -> tuple[DataFrame, DataFrame]:
        return analytics.adjacency(self.topology)
