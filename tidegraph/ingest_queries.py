"""Ingest, state across batches, the store, the stream, tools and errors as queries, each with SQL that DuckDB runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import queries as Q
from .config import GeneratorConfig, IngestConfig
from .engine import Engine
from .errors import EngineError
from .operators import analytics as A
from .operators import ingest as I
from .plans import traversal as T
from .scratch import _steps, shared_dir
from .sources import generator, mapped
from .sources.decode import decode, decode_files, read_batch
from .sources.store import Store
from .streaming.pipeline import Intake, apply_batch, batch_ack, stream
from .tools import call

#: Places of a file of the stream. A file is one JSON array, which a task holds whole.
FILE_EVENTS = 10_000
#: Events up to here are the first batch, those after it the second.
_CUT = "(SELECT max(arrival_seq) // 2 FROM dep)"
#: Places, by arrival modulo 97, at which the wire form of an event is spoilt.
_BAD_STATUS, _BAD_TIME, _BAD_TYPE, _CUT_OFF, _NO_ID, _NO_LATENCY, _NO_ENDPOINT = range(1, 8)


def _own_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _steps.append((spark, path))  # goes at exit
    return path


def wire(events: DataFrame) -> DataFrame:
    """arrival_seq, value: each event as a JSON object."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    return events.select("arrival_seq", F.to_json(F.struct("type", "event_id", stamp, "source", "target", "latency_ms", "status", "service", "attributes")).alias("value"))


def _spoilt(spark, sf_dir) -> DataFrame:
    e = mapped.dep_events(spark, sf_dir)
    at = F.col("arrival_seq") % 97
    value = wire(
        e.withColumns({
            "status": F.when(F.col("status").isNotNull() & (at == _BAD_STATUS), "OK").otherwise(F.col("status")),
            "type": F.when(at == _BAD_TYPE, "fancy_new_event").otherwise(F.col("type")),
            "event_id": F.when(at == _NO_ID, " \t").otherwise(F.col("event_id")),
            "latency_ms": F.when(at != _NO_LATENCY, F.col("latency_ms")),
            "source": F.when(F.col("source").isNotNull() & (at == _NO_ENDPOINT), " ").otherwise(F.col("source")),
            "service": F.when(F.col("service").isNotNull() & (at == _NO_ENDPOINT), " ").otherwise(F.col("service")),
        })
    )
    text = F.when(at == _CUT_OFF, F.substring("value", 1, 30)).when(at == _BAD_TIME, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"yesterday"')).otherwise(F.col("value"))
    return value.select("arrival_seq", text.alias("value"))


def decoded_events(spark, sf_dir):
    """Events through the wire form and back; faulty ones are missing, blank ids dropped, a missing latency is 0."""
    events, _ = decode(_spoilt(spark, sf_dir))
    none = F.lit("-")
    return events.select("event_id", "type", Q._stamp("ts"), F.coalesce("source", none).alias("source"), F.coalesce("target", none).alias("target"), F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms"), F.coalesce("status", none).alias("status"), F.coalesce("service", none).alias("service"), F.coalesce(F.col("attributes")["team"], none).alias("team"))


def quarantine_counts(spark, sf_dir):
    return decode(_spoilt(spark, sf_dir))[1].groupBy("fault").agg(F.count(F.lit(1)).alias("events"))


#: name, text of a file, events that it holds, faults that it has
_FILES = (
    ("a-good", '[{"type":"heartbeat","event_id":"1","timestamp":"2026-01-01T00:00:00Z","service":"a"}]', 1, ""),
    ("b-truncated", '[{"type":"heart', 0, "not an array"),
    ("c-object", '{"type":"heartbeat","event_id":"2","timestamp":"2026-01-01T00:00:00Z","service":"a"}', 0, "not an array"),
    ("d-null-item", '[null,{"type":"heartbeat","event_id":"3","timestamp":"2026-01-01T00:00:00Z","service":"a"}]', 1, "malformed"),
    ("e-empty", "[]", 0, ""),
    ("f-no-zone", '[{"type":"heartbeat","event_id":"4","timestamp":"2026-01-01T00:00:00","service":"a"}]', 0, "bad timestamp"),
    ("g-no-seconds", '[{"type":"heartbeat","event_id":"5","timestamp":"2026-01-01T00:00Z","service":"a"}]', 0, "bad timestamp"),
    ("h-negative", '[{"type":"dependency_observed","event_id":"6","timestamp":"2026-01-01T00:00:00Z","source":"a","target":"b","latency_ms":-1,"status":"ok"}]', 0, "negative latency"),
    ("i-text-latency", '[{"type":"dependency_observed","event_id":"7","timestamp":"2026-01-01T00:00:00Z","source":"a","target":"b","latency_ms":"fast","status":"ok"}]', 0, "malformed"),
    ("j-blank", '[{"type":"dependency_removed","event_id":"8","timestamp":"2026-01-01T00:00:00Z","source":"\\u2003","target":"b"}]', 0, "missing endpoint"),
    ("k-no-type", '[{"event_id":"9","timestamp":"2026-01-01T00:00:00Z","service":"a"}]', 0, "unknown type"),
)


def decoded_files(spark, sf_dir):
    """For fixed files: how many events each gives, and its faults."""
    parts = []
    for name, text, *_ in _FILES:
        events, bad = decode_files(spark.range(1).select(F.lit(name).alias("file"), F.lit(text).alias("value")))
        one = events.agg(F.count(F.lit(1)).alias("events")).withColumn("faults", bad.agg(F.array_join(F.array_sort(F.collect_list("fault")), ",").alias("f")).scalar())
        parts.append(one.select(F.lit(name).alias("file"), "events", "faults"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def processed_antijoin(spark, sf_dir):
    """First arrivals of events and replays, less those that were processed before."""
    e = mapped.dep_events(spark, sf_dir, True)
    return I.first_arrivals(e, e.where("arrival_seq % 2 = 0").select("event_id")).select("event_id", "arrival_seq")


def _halves(spark, sf_dir):
    e = mapped.dep_events(spark, sf_dir)
    cut = e.agg(F.floor(F.max("arrival_seq") / 2)).first()[0] or 0
    return e.where(F.col("arrival_seq") <= cut), e.where(F.col("arrival_seq") > cut)


def _shown(state):
    return state.select("source", "target", "live", "n", F.round("avg", 6).alias("avg"), "stale_obs", "stale_rem", "unknown_rem")


def edges_of_two_batches(spark, sf_dir):
    first, second = _halves(spark, sf_dir)
    return _shown(I.edge_state(second, I.edge_state(first)))


def _nodes_shown(nodes):
    return nodes.select("id", *(F.coalesce(c, F.lit("-")).alias(c) for c in ("team", "tier", "region")), F.coalesce(F.date_format("last_heartbeat", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-")).alias("last_heartbeat"))


def nodes_of_two_batches(spark, sf_dir):
    first, second = _halves(spark, sf_dir)
    old = I.edge_state(first)
    return _nodes_shown(I.merge_nodes(second, I.edge_state(second, old), I.merge_nodes(first, old)))


def _stored(spark, sf_dir) -> tuple[Store, list[dict]]:
    """A store after two batches, the second with replays of events of both, and the reports."""
    store = Store(spark, _own_folder(spark, "store"))
    first, _ = _halves(spark, sf_dir)
    return store, [apply_batch(store, 0, first), apply_batch(store, 1, mapped.dep_events(spark, sf_dir, True))]


def store_edges(spark, sf_dir):
    return _shown(_stored(spark, sf_dir)[0].load().edge_state)


def store_nodes(spark, sf_dir):
    return _nodes_shown(_stored(spark, sf_dir)[0].load().nodes)


def store_samples(spark, sf_dir):
    """The stored samples of the health window in the order of their arrival; place: from 1 within an edge."""
    rows = _stored(spark, sf_dir)[0].samples(Q._as_of() - F.make_dt_interval(secs=F.lit(Q.WINDOW)))
    nth = F.row_number().over(Window.partitionBy("source", "target").orderBy("place"))
    return rows.select("source", "target", nth.alias("place"), Q._stamp("ts"), "latency_ms", "status")


def ingest_reports(spark, sf_dir):
    """What apply_batch says of both batches, and of a version that stands already; processed: ids in the store in the end."""
    store, reports = _stored(spark, sf_dir)
    again = apply_batch(store, 1, mapped.dep_events(spark, sf_dir))
    rows = [(r["version"], r["received"], r["applied"], r["duplicates_in_batch"], r["duplicates_before"], again["skipped"], store.processed_count()) for r in reports]
    return spark.createDataFrame(rows, "version int, received long, applied long, duplicates_in_batch long, duplicates_before long, replay_skipped boolean, processed long")


def stream_edges(spark, sf_dir):
    """The events as files of JSON arrays through the stream: four parts, each of as many files of at most FILE_EVENTS places, a trigger for each two parts."""
    folder, state = _own_folder(spark, "incoming"), _own_folder(spark, "streamed")
    rows = wire(mapped.dep_events(spark, sf_dir))
    width = (rows.agg(F.max("arrival_seq")).first()[0] or 0) // 4 + 1
    n = -(-width // FILE_EVENTS)
    for k in range(4):  # one after another, so that their order of appearance is that of the events
        own = rows.where(F.floor(F.col("arrival_seq") / width) == k).withColumn("file", F.floor((F.col("arrival_seq") - k * width) / FILE_EVENTS))
        full = own.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("arrival_seq", "value"))).alias("l"))
        files = spark.range(n).withColumnRenamed("id", "file").join(full, "file", "left")  # a file of no events is an empty array: parts have n files each
        text = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("l", lambda x: x["value"]), ","), F.lit("")), F.lit("]"))
        files.select(F.format_string("%010d", "file").alias("file"), text.alias("value")).repartition("file").write.partitionBy("file").text(f"{folder}/{k}")
    store = Store(spark, state)
    query = stream(spark, f"{folder}/*/*", store, f"{state}-checkpoint", IngestConfig(max_files_per_trigger=2 * n))
    query.awaitTermination()
    return _shown(store.load().edge_state)


def pruned_samples(spark, sf_dir):
    """Samples of each live edge that the age cap leaves."""
    oldest = Q._as_of() - F.make_dt_interval(secs=F.lit(Q.WINDOW))
    s = I.edge_state(I.first_arrivals(mapped.dep_events(spark, sf_dir)), oldest=oldest)
    return I.live_edges(s).select("source", "target", F.size("samples").cast("bigint").alias("samples"))


def batch_acks(spark, sf_dir):
    """Two offers to a buffer of 1,500 places: the events of the first half, then those of the second."""
    intake = Intake(Store(spark, _own_folder(spark, "intake")), IngestConfig(max_events_per_trigger=1500, on_overflow="shed"))
    rows = []
    for k, half in enumerate(_halves(spark, sf_dir)):
        status, ack = batch_ack(intake.offer(half))
        rows.append((k, ack["submitted"], ack["accepted"], ack["rejected"], status, intake.metrics()["size"]))
    return spark.createDataFrame(rows, "offer int, submitted long, accepted long, rejected long, status int, waiting long")


def reach_order(spark, sf_dir):
    """place: nearest first, then by id."""
    found = T.reachable(Q._topology(spark, sf_dir), Q._start(spark, "svc-00000"))
    return found.select("id", "hops", F.row_number().over(Window.orderBy("hops", "id")).alias("place"))


def cycles_order(spark, sf_dir):
    """place: shortest first, then by the ids along the cycle."""
    found = T.cycles(Q._topology(spark, sf_dir))
    return found.select(F.concat_ws(">", "cycle").alias("cycle"), F.row_number().over(Window.orderBy(F.size("cycle"), "cycle")).alias("place"))


def adjacency_averages(spark, sf_dir):
    out = A.adjacency(Q._weighted(spark, sf_dir))[0]
    return out.select("source", F.explode("outgoing").alias("target", "avg")).select("source", "target", F.round("avg", 6).alias("avg"))


def stale_observations(spark, sf_dir):
    return Q._state_disordered(spark, sf_dir).where("stale_obs > 0").select("source", "target", "stale_obs")


def stale_removals(spark, sf_dir):
    return Q._state_disordered(spark, sf_dir).where("stale_rem > 0").select("source", "target", "stale_rem")


def health_boundary_inclusive(spark, sf_dir):
    """A window that starts at the very time of the first sample: it counts."""
    s = Q._samples(spark, sf_dir)
    first = s.agg(F.min("ts").alias("m")).scalar()
    return s.where((F.col("ts") >= first) & (F.col("ts") <= first + F.expr("INTERVAL 1 DAY"))).groupBy("source", "target").agg(F.count(F.lit(1)).alias("sample_count"))


_GRAPH = [("a", "b", 10), ("b", "c", 20), ("a", "c", 50), ("c", "a", 5), ("x", "y", 7)]


def _fixture(spark) -> Engine:
    body = [{"type": "dependency_observed", "event_id": f"e{i}", "timestamp": f"2026-05-10T12:00:{i:02d}Z", "source": a, "target": b, "latency_ms": ms, "status": "ok" if i else "error"} for i, (a, b, ms) in enumerate(_GRAPH)]
    return Engine.from_json(spark, json.dumps(body))


#: name, arguments, the answer's rows
_CALLS = (
    ("reachable", {"service": "x"}, '[{"service":"x","id":"y","path":["x","y"]}]'),
    ("dependents", {"service": "b"}, '[{"service":"b","id":"a","path":["a","b"]},{"service":"b","id":"b","path":["b","c","a","b"]},{"service":"b","id":"c","path":["c","a","b"]}]'),
    ("shortest_path", {"source": "a", "target": "c"}, '[{"source":"a","target":"c","found":true,"path":["a","b","c"],"total_latency_ms":30.0}]'),
    ("shortest_path", {"source": "x", "target": "a"}, '[{"source":"x","target":"a","found":false,"path":[],"total_latency_ms":0.0}]'),
    ("critical_services", {"k": 1}, '[{"id":"a","score":2.0,"in_degree":1,"out_degree":2}]'),
    ("cycles", {}, '[{"cycle":["a","c","a"]},{"cycle":["a","b","c","a"]}]'),
    ("health", {"service": "a", "as_of": "2026-05-10T12:00:30"}, '[{"service":"a","sample_count":3,"error_rate":0.3333333333333333,"p95_latency_ms":50,"window_seconds":300}]'),
    ("reachable", {"service": "nobody"}, '{"error":"service_not_found","message":"unknown service: nobody","service":"nobody"}'),
    ("reachable", {}, '{"error":"invalid_request","message":"invalid arguments: service"}'),
    ("reachable", {"service": 7}, '{"error":"invalid_request","message":"parameter \'service\' has the wrong type"}'),
    ("reachable", {"service": "a", "depth": 2}, '{"error":"invalid_request","message":"invalid arguments: [\'depth\']"}'),
    ("critical_services", {"k": 0}, '{"error":"invalid_request","message":"invalid arguments: k"}'),
    ("health", {"service": "a", "window_seconds": 301}, '{"error":"invalid_request","message":"window exceeds configured retention"}'),
    ("health", {"service": "a", "as_of": "soon"}, '{"error":"invalid_request","message":"invalid arguments: as_of"}'),
    ("nothing", {}, '{"error":"invalid_request","message":"no such tool: nothing"}'),
)


def tool_answers(spark, sf_dir):
    """Fixed calls over a fixed graph: answers and error envelopes as JSON."""
    e = _fixture(spark)
    compact = lambda x: json.dumps(x, separators=(",", ":"))
    rows = [(i, name, compact(sorted(got, key=str) if name == "dependents" and isinstance(got, list) else got)) for i, (name, given, _) in enumerate(_CALLS) for got in [call(e, name, given)["content"]]]
    return spark.createDataFrame(rows, "call int, tool string, answer string")


#: What reading a body, offering to a closed buffer, or a faulty setting answers.
_REFUSED = (
    ("closed buffer", "service_unavailable", "pipeline is closed"),
    ("malformed body", "invalid_request", "malformed request body"),
    ("no services", "invalid_request", "at least two services and no negative number of events"),
    ("wrong status", "invalid_request", "malformed request body"),
)


def error_envelopes(spark, sf_dir):
    def closed():
        intake = Intake(Store(spark, _own_folder(spark, "closed")))
        intake.close()
        intake.offer(mapped.dep_events(spark, sf_dir))

    tries = {
        "closed buffer": closed, "malformed body": lambda: read_batch(spark, "[{"), "no services": lambda: GeneratorConfig(services=1),
        "wrong status": lambda: read_batch(spark, '[{"type":"dependency_observed","event_id":"1","timestamp":"2026-01-01T00:00:00Z","source":"a","target":"b","status":"OK"}]'),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
        except EngineError as e:
            rows.append((name, e.envelope()["error"], e.envelope()["message"]))
    return spark.createDataFrame(rows, "attempt string, error string, message string")


def generator_profile(spark, sf_dir):
    """What the generator promises, of 4,000 events of 60 services."""
    c = GeneratorConfig(services=60, events=4000, hubs=4, cycles=2, duplicate_rate=0.05)
    e, edges = generator.events(spark, c), generator.topology(spark, c)
    share = lambda kind, low, high: F.avg(F.when(F.col("type") == kind, 1.0).otherwise(0.0)).between(low, high)
    seen = F.col("type") == "dependency_observed"
    row = e.agg(
        F.count(F.lit(1)).alias("events"), (F.count_distinct("event_id") < 4000).alias("has_replays"), share("dependency_observed", 0.74, 0.82).alias("observed_share"), share("heartbeat", 0.07, 0.13).alias("heartbeat_share"),
        share("service_metadata", 0.03, 0.09).alias("metadata_share"), share("dependency_removed", 0.03, 0.09).alias("removed_share"), (F.min("latency_ms") >= 1).alias("latencies_positive"), (F.max("latency_ms") > 50).alias("long_tail"),
        F.avg(F.when(seen & (F.col("status") != "ok"), 1.0).when(seen, 0.0)).between(0.03, 0.07).alias("error_share"),
    )
    named = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    row = row.withColumn("named_services", named.where(F.col("id").isin(*generator.NAMED)).agg(F.count(F.lit(1)).alias("n")).scalar())
    return row.withColumn("cyclic", F.lit(not T.cyclic_core(edges).isEmpty()))


def _values(rows, names: str) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names})"


_AT = "arrival_seq % 97"
_EDGE = f"({Q._OBS} OR {Q._REM})"
_ALL_STATE = "SELECT source, target, s.live AS live, s.n AS n, round(s.avg, 6) AS avg, s.stale_obs AS stale_obs, s.stale_rem AS stale_rem, s.unknown_rem AS unknown_rem FROM state"
_NODES = f"""{Q._DEP}{Q._TOPO}, m AS (SELECT source AS id, arg_max(team, arrival_seq) AS team, arg_max(tier, arrival_seq) AS tier, arg_max(region, arrival_seq) AS region FROM dep WHERE type = 'service_metadata' GROUP BY 1),
h AS (SELECT source AS id, max(ts) AS ts FROM dep WHERE type = 'heartbeat' GROUP BY 1)
SELECT id, coalesce(team, '-') AS team, coalesce(tier, '-') AS tier, coalesce(region, '-') AS region, coalesce(strftime(h.ts, {Q._MICRO}), '-') AS last_heartbeat FROM nodes LEFT JOIN m USING (id) LEFT JOIN h USING (id)"""
_CAPPED = f"""{Q._SAMPLES},
capped AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY arrival_seq) AS nth FROM (
  SELECT * FROM (SELECT source, target, ts, latency_ms, status, arrival_seq FROM state JOIN dep USING (source, target) WHERE s.live AND {Q._OBS} AND ts >= s.since)
  QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY arrival_seq DESC) <= 1024))"""

SQL = {
    "decoded_events": f"""{Q._DEP} SELECT event_id, type, strftime(ts, {Q._MICRO}) AS ts, CASE WHEN {_EDGE} THEN source ELSE '-' END AS source, CASE WHEN {_EDGE} THEN target ELSE '-' END AS target,
  CASE WHEN NOT {Q._OBS} THEN -1 WHEN {_AT} = {_NO_LATENCY} THEN 0 ELSE latency_ms END AS latency_ms, CASE WHEN {Q._OBS} THEN status ELSE '-' END AS status, CASE WHEN {_EDGE} THEN '-' ELSE source END AS service,
  CASE WHEN type = 'service_metadata' THEN team ELSE '-' END AS team
FROM dep WHERE {_AT} NOT IN ({_BAD_TIME}, {_BAD_TYPE}, {_CUT_OFF}, {_NO_ID}, {_NO_ENDPOINT}) AND NOT ({_AT} = {_BAD_STATUS} AND {Q._OBS})""",
    "quarantine_counts": f"""{Q._DEP} SELECT CASE WHEN {_AT} = {_BAD_STATUS} THEN 'bad status' WHEN {_AT} = {_BAD_TIME} THEN 'bad timestamp' WHEN {_AT} = {_BAD_TYPE} THEN 'unknown type' WHEN {_AT} = {_CUT_OFF} THEN 'malformed'
  WHEN {_EDGE} THEN 'missing endpoint' ELSE 'missing service' END AS fault, count(*) AS events
FROM dep WHERE {_AT} IN ({_BAD_TIME}, {_BAD_TYPE}, {_CUT_OFF}, {_NO_ENDPOINT}) OR ({_AT} = {_BAD_STATUS} AND {Q._OBS}) GROUP BY 1""",
    "decoded_files": f"SELECT file, events::BIGINT AS events, faults FROM ({_values([(n, k, f) for n, _, k, f in _FILES], 'file, events, faults')})",
    "processed_antijoin": f"{Q._ALL} SELECT event_id, min(arrival_seq) AS arrival_seq FROM every GROUP BY 1 HAVING count(*) FILTER (arrival_seq % 2 = 0) = 0",
    "edges_of_two_batches": f"{Q._STATE} {_ALL_STATE}",
    "nodes_of_two_batches": _NODES,
    "store_edges": f"{Q._STATE} {_ALL_STATE}",
    "store_nodes": _NODES,
    "store_samples": f"{_CAPPED} SELECT source, target, CAST(row_number() OVER (PARTITION BY source, target ORDER BY nth) AS INTEGER) AS place, strftime(ts, {Q._MICRO}) AS ts, latency_ms, status FROM capped WHERE ts >= TIMESTAMP '{Q.AS_OF}' - INTERVAL {Q.WINDOW} SECOND",
    "ingest_reports": f"""{Q._ALL}, n AS (SELECT count(*) AS one, (SELECT count(*) FROM dep WHERE arrival_seq <= {_CUT}) AS half, (SELECT count(*) FROM every) AS whole FROM dep)
SELECT 0 AS version, half AS received, half AS applied, 0::BIGINT AS duplicates_in_batch, 0::BIGINT AS duplicates_before, true AS replay_skipped, one AS processed FROM n
UNION ALL SELECT 1, whole, one - half, whole - one, half, true, one FROM n""",
    "stream_edges": f"{Q._STATE} {_ALL_STATE}",
    "pruned_samples": f"{_CAPPED}, kept AS (SELECT source, target, count(*) AS n FROM capped WHERE ts >= TIMESTAMP '{Q.AS_OF}' - INTERVAL {Q.WINDOW} SECOND GROUP BY ALL) SELECT source, target, coalesce(n, 0) AS samples FROM state LEFT JOIN kept USING (source, target) WHERE s.live",
    "batch_acks": f"""{Q._DEP}, n AS (SELECT count(*) FILTER (arrival_seq <= {_CUT}) AS a, count(*) FILTER (arrival_seq > {_CUT}) AS b FROM dep)
SELECT 0 AS offer, a AS submitted, least(a, 1500) AS accepted, a - least(a, 1500) AS rejected, CASE WHEN a <= 1500 THEN 202 ELSE 503 END AS status, least(a, 1500) AS waiting FROM n
UNION ALL SELECT 1, b, least(b, 1500 - least(a, 1500)), b - least(b, 1500 - least(a, 1500)), CASE WHEN b <= 1500 - least(a, 1500) THEN 202 ELSE 503 END, least(1500, a + b) FROM n""",
    "reach_order": f"{Q._DEP}{Q._TOPO}{Q._reach(Q._FROM_0, 'target', '[]')} SELECT id, hops, CAST(row_number() OVER (ORDER BY hops, id) AS INTEGER) AS place FROM first",
    "cycles_order": f"{Q._CYCLES} SELECT array_to_string(p, '>') AS cycle, CAST(row_number() OVER (ORDER BY len(p), p) AS INTEGER) AS place FROM found",
    "adjacency_averages": f"{Q._WEIGHTED} SELECT source, target, round(w, 6) AS avg FROM w",
    "stale_observations": f"{Q._DISORDERED} SELECT source, target, s.stale_obs AS stale_obs FROM state WHERE s.stale_obs > 0",
    "stale_removals": f"{Q._DISORDERED} SELECT source, target, s.stale_rem AS stale_rem FROM state WHERE s.stale_rem > 0",
    "health_boundary_inclusive": f"{Q._SAMPLES} SELECT source, target, count(*) AS sample_count FROM samples WHERE ts >= (SELECT min(ts) FROM samples) AND ts <= (SELECT min(ts) FROM samples) + INTERVAL 1 DAY GROUP BY ALL",
    "tool_answers": _values([(i, name, answer) for i, (name, _, answer) in enumerate(_CALLS)], "call, tool, answer"),
    "error_envelopes": _values(_REFUSED, "attempt, error, message"),
    "generator_profile": "SELECT 4000::BIGINT AS events, true AS has_replays, true AS observed_share, true AS heartbeat_share, true AS metadata_share, true AS removed_share, true AS latencies_positive, true AS long_tail, true AS error_share, 13::BIGINT AS named_services, true AS cyclic",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
