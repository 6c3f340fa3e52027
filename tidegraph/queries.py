"""The engine's operators as queries over the test tables, each with SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import path_text
from .operators import analytics as A
from .operators import ingest as I
from .plans import traversal as T
from .scratch import kept
from .sources import mapped

#: Health on the test data looks back a week from here.
AS_OF, WINDOW = "2024-01-31 00:00:00", 7 * 86400


def _events(spark: SparkSession, sf_dir: str, replays: bool = False) -> DataFrame:
    return mapped.dep_events(spark, sf_dir, replays)


def _topology(spark, sf_dir):
    return I.live_topology(_events(spark, sf_dir))


def _nodes(spark, sf_dir):
    e = _events(spark, sf_dir)
    ends = e.where("type = 'dependency_observed'").select(F.explode(F.array("source", "target")).alias("id"))
    return ends.unionByName(e.where("service is not null").select(F.col("service").alias("id"))).distinct()


def _state(spark, sf_dir):
    return I.edge_state(I.first_arrivals(_events(spark, sf_dir)))


def _weighted(spark, sf_dir):
    return I.live_edges(_state(spark, sf_dir)).select("source", "target", "rolling_avg_latency_ms")


def _samples(spark, sf_dir):
    """All observations of the live edges: the cap of the engine's buffer does not bear on these queries."""
    e = I.first_arrivals(_events(spark, sf_dir))
    return I.live_observations(e, I.edge_state(e))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def _start(spark, *ids):
    return spark.range(1).select(F.explode(F.array(*map(F.lit, ids))).alias("id"))


def _as_of():
    return F.to_timestamp(F.lit(AS_OF))


def criticality_all(spark, sf_dir):
    return A.criticality(_nodes(spark, sf_dir), _topology(spark, sf_dir))


def critical_services_top10(spark, sf_dir):
    return A.critical_services(_nodes(spark, sf_dir), _topology(spark, sf_dir), 10)


def graph_counts(spark, sf_dir):
    return A.graph_counts(_nodes(spark, sf_dir), _topology(spark, sf_dir))


def edge_stats_fold(spark, sf_dir):
    return _state(spark, sf_dir).where("live").select("source", "target", "n", F.round("avg", 6).alias("avg"), _stamp("last_obs"))


def edge_drop_counters(spark, sf_dir):
    return _state(spark, sf_dir).select("source", "target", "stale_obs", "stale_rem", "unknown_rem")


def drop_totals(spark, sf_dir):
    return A.drop_counters(_state(spark, sf_dir)).select(*(F.col(c).cast("bigint").alias(c) for c in ("stale_obs", "stale_rem", "unknown_rem")))


def _shuffled(spark, sf_dir):
    """The events in disordered arrival: each up to 100 places from its own."""
    e = _events(spark, sf_dir)
    return e.withColumn("arrival_seq", (F.col("arrival_seq") + F.col("arrival_seq") * 7919 % 200 - 100) * 1_000_000 + F.col("arrival_seq"))


def _state_disordered(spark, sf_dir):
    return I.edge_state(_shuffled(spark, sf_dir))


def edge_stats_disordered(spark, sf_dir):
    return _state_disordered(spark, sf_dir).select("source", "target", "live", "n", F.round("avg", 6).alias("avg"), "stale_obs", "stale_rem", "unknown_rem")


def service_metadata_merged(spark, sf_dir):
    e = _events(spark, sf_dir)
    return I.merge_nodes(e, I.edge_state(e)).select("id", "team", "tier", "region")


def service_heartbeats(spark, sf_dir):
    e = _events(spark, sf_dir)
    return I.merge_nodes(e, I.edge_state(e)).where("last_heartbeat is not null").select("id", _stamp("last_heartbeat"))


def dedup_first_payload(spark, sf_dir):
    return I.first_arrivals(_events(spark, sf_dir, True)).select("event_id", "arrival_seq", "type", F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"))


def duplicate_counts(spark, sf_dir):
    return I.duplicate_counts(_events(spark, sf_dir, True))


def reachable_from(spark, sf_dir):
    return T.reachable(_topology(spark, sf_dir), _start(spark, "svc-00000")).select("id", "hops", path_text(F.col("path")).alias("path"))


def dependents_of(spark, sf_dir):
    return T.reachable(_topology(spark, sf_dir), _start(spark, "hub-0"), reverse=True).select("id", "hops", path_text(F.col("path")).alias("path"))


def reachable_hops(spark, sf_dir):
    return T.hop_histogram(T.reachable(_topology(spark, sf_dir), _start(spark, "svc-00000", "svc-00001", "svc-00002")))


def reach_count_all(spark, sf_dir):
    edges = kept(_topology(spark, sf_dir))
    starts = edges.select(F.col("source").alias("id")).distinct()
    return T.reach_depths(edges, starts).groupBy("start").agg(F.count(F.lit(1)).alias("reached"), F.max("hops").alias("depth"))


def sssp_all(spark, sf_dir):
    found = T.shortest_paths(kept(_weighted(spark, sf_dir)), _start(spark, "svc-00000"))
    return found.select("id", F.round("distance", 6).alias("distance"), "hops", path_text(F.col("path")).alias("path"))


def shortest_path(spark, sf_dir):
    found = T.shortest_paths(kept(_weighted(spark, sf_dir)), _start(spark, "svc-00000"), "svc-00014")
    return found.where("id = 'svc-00014'").select("start", "id", F.round("distance", 6).alias("distance"), "hops", path_text(F.col("path")).alias("path"))


def cycles_all(spark, sf_dir):
    return T.cycles(_topology(spark, sf_dir)).select(path_text(F.col("cycle")).alias("cycle"))


def cycle_length_hist(spark, sf_dir):
    return T.cycles(_topology(spark, sf_dir)).groupBy((F.size("cycle") - 1).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def self_loops(spark, sf_dir):
    return _topology(spark, sf_dir).where("source = target").select("source")


def scc_nodes(spark, sf_dir):
    return T.strong_components(_topology(spark, sf_dir), _nodes(spark, sf_dir))


def live_edges(spark, sf_dir):
    return _topology(spark, sf_dir)


def node_list(spark, sf_dir):
    return _nodes(spark, sf_dir)


def _rounded(df):
    return df.withColumn("error_rate", F.round("error_rate", 6))


def health_all_services(spark, sf_dir):
    return _rounded(A.service_health(_nodes(spark, sf_dir), _samples(spark, sf_dir), _as_of(), WINDOW))


def health_service(spark, sf_dir):
    return _rounded(A.service_health(_nodes(spark, sf_dir), _samples(spark, sf_dir), _as_of(), WINDOW, "hub-0"))


def health_edges(spark, sf_dir):
    return _rounded(A.edge_health(_samples(spark, sf_dir), _as_of(), WINDOW))


def tumbling_health(spark, sf_dir):
    return _rounded(A.tumbling_health(_samples(spark, sf_dir), "1 day")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def recent_samples_capped(spark, sf_dir):
    s = I.edge_state(_events(spark, sf_dir).where("type = 'dependency_observed'"), cap=4)
    return A.samples_of(I.live_edges(s)).select("source", "target", _stamp("ts"), "latency_ms", "status")


def adjacency_out(spark, sf_dir):
    return _topology(spark, sf_dir).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))


def adjacency_in(spark, sf_dir):
    return A.adjacency(_weighted(spark, sf_dir))[1].select("target", F.array_join("incoming", ",").alias("sources"))


def restored_samples(spark, sf_dir):
    return _samples(spark, sf_dir).where(F.col("ts") >= _as_of() - F.make_dt_interval(secs=F.lit(WINDOW))).select("source", "target", _stamp("ts"), "latency_ms", "status")


def partition_balance(spark, sf_dir):
    from .functions.scalar import route, route_key

    e = _events(spark, sf_dir)
    key = route_key(F.col("type"), F.col("source"), F.col("target"), F.col("service"))
    return e.groupBy(route(key, 8).alias("partition")).agg(F.count(F.lit(1)).alias("events"))


_DEP = f"WITH RECURSIVE dep AS ({mapped.SQL})"
_OBS = "type = 'dependency_observed'"
_REM = "type = 'dependency_removed'"
#: Edges that live, by the two maxima; times do not repeat in the test data.
_TOPO = f""",
topo AS (SELECT source, target FROM dep WHERE {_OBS} OR {_REM} GROUP BY source, target
  HAVING max(ts) FILTER ({_OBS}) IS NOT NULL AND (max(ts) FILTER ({_REM}) IS NULL OR max(ts) FILTER ({_OBS}) > max(ts) FILTER ({_REM}))),
nodes AS (SELECT source AS id FROM dep WHERE NOT ({_REM}) UNION SELECT target FROM dep WHERE {_OBS})"""
_CRIT = f"""{_DEP}{_TOPO},
crit AS (SELECT id, CAST(coalesce(i, 0) * coalesce(o, 0) AS DOUBLE) AS score, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree
  FROM nodes LEFT JOIN (SELECT target AS id, count(*) AS i FROM topo GROUP BY 1) a USING (id) LEFT JOIN (SELECT source AS id, count(*) AS o FROM topo GROUP BY 1) b USING (id))"""


def _fold(events: str) -> str:
    """The state machine of an edge as a left fold over its events in order of arrival."""
    keep = "stale_obs := s.stale_obs, stale_rem := s.stale_rem, unknown_rem := s.unknown_rem"
    return f""",
lists AS (SELECT source, target, list({{'ts': ts, 'obs': {_OBS}, 'lat': latency_ms}} ORDER BY arrival_seq) AS l FROM {events} WHERE {_OBS} OR {_REM} GROUP BY source, target),
state AS (
  SELECT source, target, list_reduce(l, lambda s, e:
    CASE WHEN e.obs AND s.tomb > e.ts THEN struct_pack(live := s.live, last_obs := s.last_obs, n := s.n, avg := s.avg, tomb := s.tomb, since := s.since, stale_obs := s.stale_obs + 1, stale_rem := s.stale_rem, unknown_rem := s.unknown_rem)
         WHEN e.obs THEN struct_pack(live := true, last_obs := CASE WHEN s.live THEN greatest(s.last_obs, e.ts) ELSE e.ts END, n := CASE WHEN s.live THEN s.n + 1 ELSE 1::BIGINT END,
           avg := CASE WHEN s.live THEN s.avg + (e.lat - s.avg) / (s.n + 1) ELSE e.lat::DOUBLE END, tomb := s.tomb, since := CASE WHEN s.live THEN s.since ELSE e.ts END, {keep})
         WHEN s.live AND s.last_obs > e.ts THEN struct_pack(live := s.live, last_obs := s.last_obs, n := s.n, avg := s.avg, tomb := s.tomb, since := s.since, stale_obs := s.stale_obs, stale_rem := s.stale_rem + 1, unknown_rem := s.unknown_rem)
         ELSE struct_pack(live := false, last_obs := s.last_obs, n := s.n, avg := s.avg, tomb := coalesce(greatest(s.tomb, e.ts), e.ts), since := s.since, stale_obs := s.stale_obs, stale_rem := s.stale_rem, unknown_rem := s.unknown_rem + CASE WHEN s.live THEN 0 ELSE 1 END) END,
    struct_pack(live := false, last_obs := NULL::TIMESTAMP, n := 0::BIGINT, avg := 0::DOUBLE, tomb := NULL::TIMESTAMP, since := NULL::TIMESTAMP, stale_obs := 0::BIGINT, stale_rem := 0::BIGINT, unknown_rem := 0::BIGINT)) AS s
  FROM lists)"""


_STATE = _DEP + _TOPO + _fold("dep")
_WEIGHTED = _STATE + ", w AS (SELECT source, target, s.avg AS w FROM state WHERE s.live)"
_SAMPLES = _STATE + f""",
samples AS (SELECT source, target, ts, latency_ms, status FROM state JOIN dep USING (source, target) WHERE s.live AND {_OBS} AND ts >= s.since)"""
_RECENT = _SAMPLES + f", recent AS (SELECT * FROM samples WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {WINDOW} SECOND)"
_MEASURES = "count(*) AS sample_count, round(avg(CASE WHEN status <> 'ok' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, CAST(quantile_disc(latency_ms, 0.95) AS INTEGER) AS p95_latency_ms"
_SERVICE = f""",
incident AS (SELECT source AS service, latency_ms, status FROM recent UNION ALL SELECT target, latency_ms, status FROM recent WHERE source <> target),
measured AS (SELECT service, {_MEASURES} FROM incident GROUP BY service),
health AS (SELECT id AS service, coalesce(sample_count, 0) AS sample_count, coalesce(error_rate, 0) AS error_rate, coalesce(p95_latency_ms, 0) AS p95_latency_ms FROM nodes LEFT JOIN measured ON id = service)"""


def _reach(starts: str, step: str, path: str) -> str:
    return f""",
walk AS (
  SELECT s.id AS start, {step} AS id, 1 AS hops FROM ({starts}) s JOIN topo ON s.id = {'source' if step == 'target' else 'target'}
  UNION SELECT start, {step}, hops + 1 FROM walk JOIN topo ON walk.id = {'source' if step == 'target' else 'target'} WHERE hops < 40 AND walk.id <> start),
first AS (SELECT start, id, min(hops) AS hops FROM walk GROUP BY start, id),
ways AS (
  SELECT s.id AS start, s.id AS id, 0 AS hops, [s.id] AS path FROM ({starts}) s
  UNION ALL (SELECT ways.start, f.id, f.hops, {path} AS path
    FROM ways JOIN topo ON ways.id = {'source' if step == 'target' else 'target'} JOIN first f ON f.start = ways.start AND f.id = {step} AND f.hops = ways.hops + 1
    WHERE ways.hops = 0 OR ways.id <> ways.start)),
reach AS (SELECT start, id, any_value(hops) AS hops, min(path) AS path FROM ways WHERE hops > 0 GROUP BY start, id)"""


_FROM_0 = "SELECT 'svc-00000' AS id"
_PATHS = _WEIGHTED + """,
ways AS (
  SELECT 'svc-00000' AS id, 0::DOUBLE AS d, 0 AS h, ['svc-00000'] AS p
  UNION ALL SELECT target, d + w, h + 1, list_append(p, target) FROM ways JOIN w ON id = source WHERE NOT list_contains(p, target)),
best AS (SELECT id, min({'d': d, 'h': h, 'p': p}) AS b FROM ways GROUP BY id)"""
_CYCLES = _DEP + _TOPO + """,
grow AS (
  SELECT source AS start, target AS node, [source, target] AS p FROM topo WHERE target > source
  UNION ALL SELECT start, target, list_append(p, target) FROM grow JOIN topo ON node = source
  WHERE node <> start AND (target = start OR (target > start AND NOT list_contains(p, target)))),
found AS (SELECT p FROM grow WHERE node = start UNION ALL SELECT [source, target] FROM topo WHERE source = target)"""
_DISORDERED = f"{_DEP}{_TOPO}, mixed AS (SELECT * REPLACE ((arrival_seq + arrival_seq * 7919 % 200 - 100) * 1000000 + arrival_seq AS arrival_seq) FROM dep){_fold('mixed')}"
_ALL = f"{_DEP}, every AS ({mapped.REPLAY_SQL})"
_MICRO = "'%Y-%m-%d %H:%M:%S.%f'"

SQL = {
    "criticality_all": f"{_CRIT} SELECT * FROM crit",
    "critical_services_top10": f"{_CRIT} SELECT * FROM crit ORDER BY score DESC, id LIMIT 10",
    "graph_counts": f"{_DEP}{_TOPO} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM topo) AS edge_count",
    "edge_stats_fold": f"{_STATE} SELECT source, target, s.n AS n, round(s.avg, 6) AS avg, strftime(s.last_obs, {_MICRO}) AS last_obs FROM state WHERE s.live",
    "edge_drop_counters": f"{_STATE} SELECT source, target, s.stale_obs AS stale_obs, s.stale_rem AS stale_rem, s.unknown_rem AS unknown_rem FROM state",
    "drop_totals": f"{_STATE} SELECT sum(s.stale_obs)::BIGINT AS stale_obs, sum(s.stale_rem)::BIGINT AS stale_rem, sum(s.unknown_rem)::BIGINT AS unknown_rem FROM state",
    "edge_stats_disordered": f"{_DISORDERED} SELECT source, target, s.live AS live, s.n AS n, round(s.avg, 6) AS avg, s.stale_obs AS stale_obs, s.stale_rem AS stale_rem, s.unknown_rem AS unknown_rem FROM state",
    "service_metadata_merged": f"{_DEP}{_TOPO} SELECT id, team, tier, region FROM nodes LEFT JOIN (SELECT source AS id, arg_max(team, arrival_seq) AS team, arg_max(tier, arrival_seq) AS tier, arg_max(region, arrival_seq) AS region FROM dep WHERE type = 'service_metadata' GROUP BY 1) m USING (id)",
    "service_heartbeats": f"{_DEP} SELECT source AS id, strftime(max(ts), {_MICRO}) AS last_heartbeat FROM dep WHERE type = 'heartbeat' GROUP BY 1",
    "dedup_first_payload": f"{_ALL} SELECT event_id, arrival_seq, type, CASE WHEN {_OBS} THEN latency_ms ELSE -1 END AS latency_ms FROM every QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival_seq) = 1",
    "duplicate_counts": f"{_ALL} SELECT event_id, count(*) AS deliveries FROM every GROUP BY 1 HAVING count(*) > 1",
    "reachable_from": f"{_DEP}{_TOPO}{_reach(_FROM_0, 'target', 'list_append(ways.path, target)')} SELECT id, hops, array_to_string(path, '>') AS path FROM reach",
    "dependents_of": f"""{_DEP}{_TOPO}{_reach("SELECT 'hub-0' AS id", 'source', 'list_prepend(source, ways.path)')} SELECT id, hops, array_to_string(path, '>') AS path FROM reach""",
    "reachable_hops": f"""{_DEP}{_TOPO}{_reach("SELECT unnest(['svc-00000', 'svc-00001', 'svc-00002']) AS id", 'target', '[]')} SELECT start, hops, count(*) AS n FROM first GROUP BY ALL""",
    "reach_count_all": f"{_DEP}{_TOPO}{_reach('SELECT DISTINCT source AS id FROM topo', 'target', '[]')} SELECT start, count(*) AS reached, max(hops) AS depth FROM first GROUP BY 1",
    "sssp_all": f"{_PATHS} SELECT id, round(b.d, 6) AS distance, b.h AS hops, array_to_string(b.p, '>') AS path FROM best",
    "shortest_path": f"{_PATHS} SELECT 'svc-00000' AS start, id, round(b.d, 6) AS distance, b.h AS hops, array_to_string(b.p, '>') AS path FROM best WHERE id = 'svc-00014'",
    "cycles_all": f"{_CYCLES} SELECT array_to_string(p, '>') AS cycle FROM found",
    "cycle_length_hist": f"{_CYCLES} SELECT CAST(len(p) - 1 AS INTEGER) AS length, count(*) AS n FROM found GROUP BY 1",
    "self_loops": f"{_DEP}{_TOPO} SELECT source FROM topo WHERE source = target",
    "scc_nodes": f"{_DEP}{_TOPO}, r AS (SELECT source AS a, target AS b FROM topo UNION SELECT a, target FROM r JOIN topo ON b = source) SELECT id, coalesce(least(id, min(x.b)), id) AS component FROM nodes LEFT JOIN (SELECT p.a, p.b FROM r p JOIN r q ON p.a = q.b AND p.b = q.a) x ON id = x.a GROUP BY id",
    "live_edges": f"{_DEP}{_TOPO} SELECT source, target FROM topo",
    "node_list": f"{_DEP}{_TOPO} SELECT id FROM nodes",
    "health_all_services": f"{_RECENT}{_SERVICE} SELECT * FROM health",
    "health_service": f"{_RECENT}{_SERVICE} SELECT * FROM health WHERE service = 'hub-0'",
    "health_edges": f"{_RECENT} SELECT source, target, {_MEASURES} FROM recent GROUP BY source, target",
    "tumbling_health": f"{_SAMPLES} SELECT source, target, strftime(ts, '%Y-%m-%d') AS window_start, {_MEASURES} FROM samples GROUP BY ALL",
    "recent_samples_capped": f"{_DEP} SELECT source, target, strftime(ts, {_MICRO}) AS ts, latency_ms, status FROM dep WHERE {_OBS} QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY arrival_seq DESC) <= 4",
    "adjacency_out": f"{_DEP}{_TOPO} SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM topo GROUP BY 1",
    "adjacency_in": f"{_DEP}{_TOPO} SELECT target, string_agg(source, ',' ORDER BY source) AS sources FROM topo GROUP BY 1",
    "partition_balance": f"""{_DEP} SELECT CAST(('0x' || md5(CASE WHEN {_OBS} OR {_REM} THEN source || chr(31) || target ELSE source END)[1:8])::BIGINT % 8 AS INTEGER) AS partition, count(*) AS events FROM dep GROUP BY 1""",
    "restored_samples": f"{_RECENT} SELECT source, target, strftime(ts, {_MICRO}) AS ts, latency_ms, status FROM recent",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
