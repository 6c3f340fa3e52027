"""A seeded synthetic load: services with hubs and planted cycles, and a stream of events over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GeneratorConfig

LAST_REPLAYED = 64


def _u(seed: int, salt: str, *key) -> Column:
    """A number in [0, 1) that depends on seed, salt and key alone, so any partitioning gives the same load."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key), F.lit(1 << 40)) / F.lit(float(1 << 40))


#: The services that have names of their own.
NAMED = ("checkout-api", "payments-service", "auth-service", "cache-redis", "db-primary", "db-replica", "logger", "search-index", "user-profile", "inventory-service", "shipping-api", "notifications", "billing")


def _name(c: Column, config: GeneratorConfig) -> Column:
    """The id of a service by its number, names dealt out in an order that the seed chooses."""
    n = config.services
    factor = next(f for f in range(n * 5 // 8 + config.seed % 97 + 1, 2 * n + 200) if math.gcd(f, n) == 1)
    k = (c.cast("long") * factor + config.seed) % n
    return F.coalesce(F.get(F.array(*map(F.lit, NAMED)), k.cast("int")), F.format_string("svc-%05d", k))


def topology(spark: SparkSession, c: GeneratorConfig) -> DataFrame:
    """source, target: one to three edges a service, half of them to hubs, and cycles of two to four services."""
    pick = lambda salt, n: F.floor(_u(c.seed, salt, "id", "k") * n)
    base = spark.range(c.services).withColumn("k", F.explode(F.sequence(F.lit(1), (1 + F.floor(_u(c.seed, "fan", "id") * 3)).cast("int"))))
    to = F.when((_u(c.seed, "hub", "id", "k") < 0.5) & F.lit(c.hubs > 0), pick("to-hub", max(c.hubs, 1))).otherwise(pick("to", c.services))
    edges = base.select(F.col("id").alias("a"), to.alias("b")).where("a <> b")
    ring = spark.range(c.cycles).withColumn("n", (2 + F.floor(_u(c.seed, "ring", "id") * 3)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    member = lambda k: F.floor(_u(c.seed, "member", "id", k) * c.services)
    rings = ring.select(member(F.col("k")).alias("a"), member((F.col("k") + 1) % F.col("n")).alias("b"))
    return edges.unionByName(rings).distinct().select(_name(F.col("a"), c).alias("source"), _name(F.col("b"), c).alias("target"))


def events(spark: SparkSession, c: GeneratorConfig = GeneratorConfig(), start: str = "2026-01-01 00:00:00") -> DataFrame:
    """78 % observations, 10 % heartbeats, 6 % metadata, 6 % removals; a share replays one of the 64 events before."""
    edges = topology(spark, c)
    n = edges.count()
    numbered = edges.select((F.row_number().over(Window.orderBy("source", "target")) - 1).cast("bigint").alias("edge"), "source", "target")  # as many rows as the settings ask for
    rows = spark.range(c.events).withColumn("i", F.when((_u(c.seed, "dup", "id") < c.duplicate_rate) & (F.col("id") > 0), F.col("id") - 1 - F.floor(_u(c.seed, "back", "id") * F.least(F.col("id"), F.lit(LAST_REPLAYED)))).otherwise(F.col("id")))
    kind, long_tail, bad = _u(c.seed, "kind", "i"), _u(c.seed, "tail", "i"), _u(c.seed, "bad", "i")
    rows = rows.select(
        F.col("id").alias("arrival_seq"), F.format_string("e-%08x-%08x", F.lit(c.seed), F.col("i")).alias("event_id"),
        F.when(kind < 0.78, "dependency_observed").when(kind < 0.88, "heartbeat").when(kind < 0.94, "service_metadata").otherwise("dependency_removed").alias("type"),
        (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=((F.col("i") + F.floor(_u(c.seed, "jitter", "i") * 201) - 100) / 1000).cast("decimal(18,6)"))).alias("ts"),
        F.floor(_u(c.seed, "edge", "i") * n).alias("edge"), _name(F.floor(_u(c.seed, "service", "i") * c.services), c).alias("service"),
        F.when(long_tail < 0.95, 1 + F.floor(_u(c.seed, "ms", "i") * 50)).otherwise(50 + F.floor(_u(c.seed, "ms", "i") * 450)).cast("int").alias("latency_ms"),
        F.when(bad >= c.error_rate, "ok").when(bad < c.error_rate / 2, "error").otherwise("timeout").alias("status"), "i",
    )
    edge, seen = F.col("type").isin("dependency_observed", "dependency_removed"), F.col("type") == "dependency_observed"
    return rows.join(numbered, "edge").select(
        "arrival_seq", "type", "event_id", "ts", F.when(edge, F.col("source")).alias("source"), F.when(edge, F.col("target")).alias("target"),
        F.when(seen, F.col("latency_ms")).alias("latency_ms"), F.when(seen, F.col("status")).alias("status"), F.when(~edge, F.col("service")).alias("service"),
        F.when(F.col("type") == "service_metadata", F.create_map(F.lit("team"), F.format_string("team-%d", F.col("i") % 8), F.lit("tier"), F.format_string("tier-%d", F.col("i") % 3), F.lit("region"), F.format_string("region-%d", F.col("i") % 4))).alias("attributes"),
    )
