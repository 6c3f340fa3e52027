"""Deduplication by first arrival, nodes, and the per-edge state."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import EDGE_STATE, HEARTBEAT, METADATA, OBSERVED, REMOVED

_SAMPLES = "array<struct<ts:timestamp,latency_ms:int,status:string>>"


def first_arrivals(events: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """The first event of each id by arrival; ids that `processed` holds are dropped.

    A grouped minimum over (arrival_seq, payload), so repeated ids are cut down before the shuffle.
    """
    fields = [c for c in events.columns if c not in ("event_id", "arrival_seq")]
    first = events.groupBy("event_id").agg(F.min_by(F.struct("arrival_seq", *fields), "arrival_seq").alias("e")).select("event_id", "e.*").select(*events.columns)
    return first if processed is None else first.join(processed.select("event_id"), "event_id", "left_anti").select(*events.columns)


def duplicate_counts(events: DataFrame) -> DataFrame:
    """event_id, deliveries of ids that were delivered more than once."""
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")


_LONG_SAMPLES = "array<struct<ts:bigint,latency_ms:int,status:string>>"
_FOLDED = "source string, target string, live boolean, last_obs bigint, n bigint, avg double, tombstone bigint, stale_obs bigint, stale_rem bigint, unknown_rem bigint, accepted boolean, samples " + _LONG_SAMPLES
_FIELDS = [f.name for f in EDGE_STATE.fields]
_BLANK = {"live": False, "last_obs": None, "n": 0, "avg": 0.0, "tombstone": None, "stale_obs": 0, "stale_rem": 0, "unknown_rem": 0, "accepted": False}


class _Edge:
    """The state machine of one edge; times are microseconds."""

    def __init__(self, source: str, target: str, cap: int, oldest: int | None):
        self.key, self.oldest, self.samples = (source, target), oldest, deque(maxlen=cap)
        self.__dict__.update(_BLANK)

    def restore(self, old: dict) -> None:
        self.__dict__.update({k: old[k] for k in _BLANK})
        self.samples.extend(s for s in old["samples"] or () if self.oldest is None or s["ts"] >= self.oldest)

    def observe(self, ts: int, latency: int, status: str) -> None:
        if self.tombstone is not None and self.tombstone > ts:
            self.stale_obs += 1
            return
        if not self.live:
            self.live, self.n, self.avg, self.last_obs = True, 0, 0.0, ts
            self.samples.clear()
        self.n += 1
        self.avg += (latency - self.avg) / self.n
        self.last_obs, self.accepted = max(self.last_obs, ts), True
        if self.oldest is None or ts >= self.oldest:
            self.samples.append({"ts": ts, "latency_ms": latency, "status": status})

    def remove(self, ts: int) -> None:
        if self.live and self.last_obs > ts:
            self.stale_rem += 1
            return
        self.tombstone = ts if self.tombstone is None else max(self.tombstone, ts)
        self.unknown_rem += not self.live
        self.live = False

    def row(self) -> dict:
        return {"source": self.key[0], "target": self.key[1], **{k: self.__dict__[k] for k in _BLANK}, "samples": list(self.samples)}


def _in_order(cap: int):
    """Batches of rows by edge and arrival, an edge's prior state before its events, to a row for each edge. Of an edge only its state is held."""

    def run(batches):
        edge, out, schema = None, [], _arrow_schema()
        for b in batches:
            names = ("source", "target", "observed", "ts", "latency_ms", "status", "oldest", "old")
            for source, target, observed, ts, latency, status, oldest, old in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if edge is None or edge.key != (source, target):
                    if edge:
                        out.append(edge.row())
                    edge = _Edge(source, target, cap, oldest)
                if old is not None:
                    edge.restore(old)
                elif observed:
                    edge.observe(ts, latency, status)
                else:
                    edge.remove(ts)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if edge:
            yield pa.RecordBatch.from_pylist([edge.row()], schema=schema)

    return run


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}
    samples = pa.list_(pa.struct([("ts", pa.int64()), ("latency_ms", pa.int32()), ("status", pa.string())]))
    return pa.schema([(name, kinds.get(kind, samples)) for name, kind in (f.split(" ", 1) for f in _FOLDED.split(", "))])


def _as_long(samples) -> Column:
    return F.transform(samples, lambda s: F.struct(F.unix_micros(s["ts"]).alias("ts"), s["latency_ms"].alias("latency_ms"), s["status"].alias("status")))


def _rolling(latencies) -> Column:
    """The rolling average over latencies in order of arrival, step by step as the state machine takes it: the quotient of the sums has other last bits."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("avg"))
    step = lambda s, e: F.struct((s["n"] + 1).alias("n"), (s["avg"] + (e["x"] - s["avg"]) / (s["n"] + 1)).alias("avg"))
    return F.aggregate(latencies, zero, step, lambda s: s["avg"])


def edge_state(events: DataFrame, previous: DataFrame | None = None, cap: int = 1024, oldest: Column | None = None) -> DataFrame:
    """EDGE_STATE after deduplicated events. previous: the state before them, edges without events pass through.

    Edges without removals, prior state or more than `cap` observations are plain aggregates. The others, whose
    numbers depend on the order of arrival, are sorted by edge and arrival, which spills, and stream through the state
    machine: a task holds one edge's state and its `cap` samples, however many events an edge has.
    """
    edges = events.where(F.col("type").isin(OBSERVED, REMOVED)).select("source", "target", "type", "ts", "latency_ms", "status", "arrival_seq")
    counts = edges.groupBy("source", "target").agg(F.count(F.when(F.col("type") == REMOVED, 1)).alias("_removals"), F.count(F.lit(1)).alias("_events"))
    ordered = (F.col("_removals") > 0) | (F.col("_events") > cap)
    if previous is not None:
        counts = counts.join(previous.select("source", "target", F.lit(True).alias("_had")), ["source", "target"], "left")
        ordered = ordered | F.coalesce("_had", F.lit(False))
    marked = edges.join(counts.select("source", "target", ordered.alias("_ordered")), ["source", "target"])
    sample = F.struct("ts", "latency_ms", "status")
    in_time = F.lit(True) if oldest is None else F.col("ts") >= oldest
    by_arrival = F.array_sort(F.collect_list(F.when(in_time, F.struct("arrival_seq", sample.alias("s")))))  # of at most cap
    latencies = F.array_sort(F.collect_list(F.struct("arrival_seq", F.col("latency_ms").cast("double").alias("x"))))
    zero = F.lit(0).cast("bigint")
    plain = marked.where(~F.col("_ordered")).groupBy("source", "target").agg(
        F.lit(True).alias("live"), F.max("ts").alias("last_obs"), F.count(F.lit(1)).alias("n"), _rolling(latencies).alias("avg"), F.lit(None).cast("timestamp").alias("tombstone"),
        zero.alias("stale_obs"), zero.alias("stale_rem"), zero.alias("unknown_rem"), F.lit(True).alias("accepted"), F.transform(by_arrival, lambda x: x["s"]).cast(_SAMPLES).alias("samples"),
    )
    old_kind = "struct<" + ",".join(f.replace(" ", ":", 1) for f in _FOLDED.split(", ")[2:]) + ">"
    limit = F.lit(None).cast("bigint") if oldest is None else F.unix_micros(oldest)
    steps = marked.where("_ordered").select("source", "target", F.col("arrival_seq").alias("_seq"), (F.col("type") == OBSERVED).alias("observed"), F.unix_micros("ts").alias("ts"), "latency_ms", "status", limit.alias("oldest"), F.lit(None).cast(old_kind).alias("old"))
    if previous is not None:
        longs = [F.unix_micros(c).alias(c) if c in ("last_obs", "tombstone") else _as_long(F.col(c)).alias(c) if c == "samples" else F.col(c) for c in _FIELDS[2:]]
        known = previous.join(edges.select("source", "target").distinct(), ["source", "target"], "left_semi")
        nothing = {"observed": "boolean", "ts": "bigint", "latency_ms": "int", "status": "string"}
        steps = steps.unionByName(known.select("source", "target", F.lit(-(1 << 63)).alias("_seq"), *(F.lit(None).cast(k).alias(c) for c, k in nothing.items()), limit.alias("oldest"), F.struct(*longs).cast(old_kind).alias("old")))
    # Dealt by a struct: an exchange by the columns of the join below is optimized out, and AQE then reads that join by mapper or splits its large partitions
    folded = steps.repartition(F.struct("source", "target")).sortWithinPartitions("source", "target", "_seq").mapInArrow(_in_order(cap), _FOLDED)
    folded = folded.withColumns({"last_obs": F.timestamp_micros("last_obs"), "tombstone": F.timestamp_micros("tombstone"), "samples": F.transform("samples", lambda s: F.struct(F.timestamp_micros(s["ts"]).alias("ts"), s["latency_ms"].alias("latency_ms"), s["status"].alias("status")))})
    out = plain.select(*_FIELDS).unionByName(folded.select(*_FIELDS))
    if previous is not None:
        out = out.unionByName(previous.join(edges.select("source", "target").distinct(), ["source", "target"], "left_anti").select(*_FIELDS))
    return out


def live_edges(state: DataFrame) -> DataFrame:
    return state.where("live").select("source", "target", F.col("avg").alias("rolling_avg_latency_ms"), F.col("n").alias("sample_count"), F.col("last_obs").alias("last_observed_ts"), "samples")


def live_observations(events: DataFrame, state: DataFrame) -> DataFrame:
    """source, target, ts, latency_ms, status of all observations of each live edge since it came to life, without a cap.

    These are the last n accepted ones: since then the tombstone has stood still, observations before it were stale, and no
    accepted one of an earlier life is after it.
    """
    live = state.where("live").select("source", "target", "n", "tombstone")
    seen = events.where(F.col("type") == OBSERVED).select("source", "target", "ts", "latency_ms", "status", "arrival_seq").join(live, ["source", "target"])
    names = ["source", "target", "ts", "latency_ms", "status"]
    back = Window.partitionBy("source", "target").orderBy(F.desc("arrival_seq"))
    again = seen.where("ts >= tombstone").withColumn("_back", F.row_number().over(back)).where("_back <= n")
    return seen.where("tombstone is null").select(*names).unionByName(again.select(*names))


def live_topology(events: DataFrame) -> DataFrame:
    """source, target of the live edges, from two maxima: no order, no list, no state.

    With the last observation at L and the last removal at M an edge lives if there is no removal, or L > M, or
    L = M and the event of that time that arrived last is an observation.
    """
    edges = events.where(F.col("type").isin(OBSERVED, REMOVED))
    last = lambda kind: F.max(F.when(F.col("type") == kind, F.struct("ts", "arrival_seq")))
    return edges.groupBy("source", "target").agg(last(OBSERVED).alias("o"), last(REMOVED).alias("r")).where("o is not null and (r is null or o > r)").select("source", "target")


def merge_nodes(events: DataFrame, state: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """NODES: from accepted observations, metadata (by field, the last to arrive) and heartbeats (the newest)."""
    own = events.where(F.col("type").isin(METADATA, HEARTBEAT))
    fields = [F.max_by(F.col("attributes")[k], F.when(F.col("attributes")[k].isNotNull(), F.col("arrival_seq"))).alias(k) for k in ("team", "tier", "region")]
    told = own.groupBy(F.col("service").alias("id")).agg(*fields, F.max(F.when(F.col("type") == HEARTBEAT, F.col("ts"))).alias("last_heartbeat"))
    ends = state.where("accepted").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    now = told.join(ends, "id", "full_outer")
    if previous is None:
        return now.select("id", "team", "tier", "region", "last_heartbeat")
    old = previous.toDF("id", "o_team", "o_tier", "o_region", "o_heartbeat")
    both = now.join(old, "id", "full_outer")
    return both.select("id", *(F.coalesce(k, f"o_{k}").alias(k) for k in ("team", "tier", "region")), F.greatest("last_heartbeat", "o_heartbeat").alias("last_heartbeat"))
