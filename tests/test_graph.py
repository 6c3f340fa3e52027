"""The engine over small graphs whose answers are known."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidegraph import ingest_queries
from tidegraph.config import GeneratorConfig, HealthConfig, IngestConfig
from tidegraph.engine import Engine
from tidegraph.errors import InvalidRequest, PipelineClosed, UnknownService
from tidegraph.operators.ingest import duplicate_counts, edge_state, first_arrivals, live_topology
from tidegraph.schemas import EVENTS
from tidegraph.sources import generator
from tidegraph.sources.decode import read_batch, read_files
from tidegraph.sources.store import Store
from tidegraph.streaming.pipeline import Intake, apply_batch, stream
from tidegraph.tools import call

NOW = dt.datetime(2026, 5, 10, 12, 0, 0)


def at(seconds):
    return (NOW + dt.timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def obs(i, edge, latency=10, second=None, status="ok"):
    a, b = edge.split(">")
    return {"type": "dependency_observed", "event_id": f"e{i}", "timestamp": at(i if second is None else second), "source": a, "target": b, "latency_ms": latency, "status": status}


def rem(i, edge, second):
    a, b = edge.split(">")
    return {"type": "dependency_removed", "event_id": f"e{i}", "timestamp": at(second), "source": a, "target": b}


def engine(spark, *events, **kw):
    return Engine.from_json(spark, json.dumps(list(events)), **kw)


def graph(spark, text):
    return engine(spark, *(obs(i, e.split(":")[0], int(e.split(":")[1]) if ":" in e else 10) for i, e in enumerate(text.split())))


def paths(df):
    return {r["id"]: r["path"] for r in df.collect()}


def cycles(e):
    return [r["cycle"] for r in e.cycles().collect()]


def test_chain_and_paths(spark):
    e = graph(spark, "a>b:10 b>c:20 c>d:30")
    assert list(paths(e.reachable("a"))) == ["b", "c", "d"]
    assert paths(e.dependents("d")) == {"c": ["c", "d"], "b": ["b", "c", "d"], "a": ["a", "b", "c", "d"]}
    r = e.shortest_path("a", "d").first()
    assert (r["found"], r["path"], r["total_latency_ms"]) == (True, ["a", "b", "c", "d"], 60.0)
    r = e.shortest_path("a", "a").first()
    assert (r["found"], r["path"], r["total_latency_ms"]) == (True, ["a"], 0.0)
    r = e.shortest_path("d", "a").first()
    assert (r["found"], r["path"], r["total_latency_ms"]) == (False, [], 0.0)
    assert cycles(e) == []
    with pytest.raises(UnknownService):
        e.reachable("nobody")


def test_diamond_and_ties(spark):
    assert graph(spark, "a>b:10 a>c:50 b>d:10 c>d:5").shortest_path("a", "d").first()["path"] == ["a", "b", "d"]
    assert graph(spark, "a>c:10 a>b:10 b>d:10 c>d:10").shortest_path("a", "d").first()["path"] == ["a", "b", "d"]


def test_cycles(spark):
    e = graph(spark, "a>a")
    assert cycles(e) == [["a", "a"]] and paths(e.reachable("a")) == {"a": ["a", "a"]}
    assert e.critical_services(5).collect()[0]["score"] == 1.0
    e = graph(spark, "a>b b>a")
    assert cycles(e) == [["a", "b", "a"]]
    assert paths(e.reachable("a")) == {"b": ["a", "b"], "a": ["a", "b", "a"]}
    assert paths(e.dependents("a")) == {"b": ["b", "a"], "a": ["a", "b", "a"]}
    e = graph(spark, "a>b b>c c>a b>d d>b")
    assert cycles(e) == [["b", "d", "b"], ["a", "b", "c", "a"]]
    assert [(r["id"], r["score"]) for r in e.critical_services(9).collect()] == [("b", 4.0), ("a", 1.0), ("c", 1.0), ("d", 1.0)]
    with pytest.raises(InvalidRequest):
        e.critical_services(0)


def test_nodes_without_edges(spark):
    one = [{"type": "heartbeat", "event_id": "h", "timestamp": at(0), "service": "lonely"}]
    one += [{"type": "service_metadata", "event_id": f"m{k}", "timestamp": at(0), "service": "lonely", "attributes": {k: v, "other": "x"}} for k, v in (("team", "platform"), ("region", "us-east-1"), ("tier", "tier-3"))]
    e = engine(spark, *one)
    assert e.reachable("lonely").count() == 0 and e.dependents("lonely").count() == 0
    assert e.nodes.first()[:4] == ("lonely", "platform", "tier-3", "us-east-1")
    assert engine(spark).cycles().count() == 0


def test_first_arrival_wins(spark):
    same = [obs(1, "a>b", x, 0, s) for x, s in ((10, "ok"), (999, "error"), (1, "timeout"))]
    events = read_batch(spark, json.dumps(same))
    assert first_arrivals(events).first()["latency_ms"] == 10
    assert duplicate_counts(events).first()["deliveries"] == 3
    assert edge_state(first_arrivals(events)).first()["n"] == 1


def test_out_of_order(spark):
    e = engine(spark, rem(1, "a>b", 0), rem(2, "ghost>gone", 1), obs(3, "x>y", 10, 2))
    assert {r["id"] for r in e.nodes.collect()} == {"x", "y"} and e.drop_counters().first()["unknown_rem"] == 2
    r = engine(spark, obs(1, "a>b", 10, 0), rem(2, "a>b", 1), obs(3, "a>b", 20, 2)).edges.first()
    assert (r["sample_count"], r["rolling_avg_latency_ms"]) == (1, 20.0)
    e = engine(spark, obs(1, "a>b", 10, 0), rem(2, "a>b", 30), obs(3, "a>b", 99, 15))
    assert e.edges.count() == 0 and e.nodes.count() == 2 and e.drop_counters().first()["stale_obs"] == 1
    e = engine(spark, obs(1, "a>b", 10, 10), rem(2, "a>b", 5))
    assert e.edges.count() == 1 and e.drop_counters().first()["stale_rem"] == 1


def test_health(spark):
    e = engine(spark, *(obs(i, "s>t", i, i - 21) for i in range(1, 21)))
    assert e.health("s", NOW).first()[:4] == ("s", 20, 0.0, 19)
    assert e.health("t", NOW).first()["sample_count"] == 20
    e = engine(spark, *(obs(i, "s>t", 100, -i, s) for i, s in enumerate(["ok"] * 7 + ["error"] * 2 + ["timeout"])))
    assert e.health("s", NOW).first()[1:4] == (10, 0.3, 100)
    e = engine(spark, *(obs(i, "s>t", x, s) for i, (x, s) in enumerate([(999, -600), (999, -360), (50, -300), (80, -150), (120, 0)])))
    assert e.health("s", NOW).first()[1:4] == (3, 0.0, 120)
    r = e.edges.first()
    assert (r["sample_count"], round(r["rolling_avg_latency_ms"], 1)) == (5, 449.6)
    assert engine(spark, obs(1, "s>t", 1, -600)).health("s", NOW).first()[1:4] == (0, 0.0, 0)
    for bad in (0, 301):
        with pytest.raises(InvalidRequest):
            e.health("s", NOW, bad)
    with pytest.raises(UnknownService):
        e.health("nobody", NOW, 0)
    e = engine(spark, *(obs(i, "s>s", i, -i) for i in range(1, 11)), health=HealthConfig(300, 4))
    assert e.health("s", NOW).first()["sample_count"] == 4


@pytest.mark.parametrize("body", ['[{"type": "dependency_obs', json.dumps([obs(1, "a>b", status="OK")]), json.dumps([obs(1, "a>b") | {"type": "fancy_new_event"}]), json.dumps([obs(1, "a>b") | {"timestamp": "yesterday"}]), json.dumps([obs(1, "a>b", -1)])])
def test_bad_bodies(spark, body):
    with pytest.raises(InvalidRequest, match="malformed request body"):
        read_batch(spark, body)


def test_missing_latency_and_blank_ids(spark):
    e = obs(1, "a>b")
    del e["latency_ms"]
    assert read_batch(spark, json.dumps([e, obs(2, "a>b") | {"event_id": " \t"}])).collect()[0]["latency_ms"] == 0


def model(events):
    """An edge's state, event by event."""
    live, last, n, avg, tomb, c = False, None, 0, 0.0, None, [0, 0, 0]
    for kind, ts, lat in events:
        if kind == "o":
            if tomb is not None and tomb > ts:
                c[0] += 1
                continue
            if not live:
                live, last, n, avg = True, ts, 0, 0.0
            n += 1
            avg += (lat - avg) / n
            last = max(last, ts)
        elif live and last > ts:
            c[1] += 1
        else:
            tomb = ts if tomb is None else max(tomb, ts)
            if live:
                live = False
            else:
                c[2] += 1
    return live, n, round(avg, 9), *c


def _random_lists(seed, edges):
    rng = random.Random(seed)
    return {k: [(rng.choice("oor"), rng.randrange(12), rng.randrange(50)) for _ in range(rng.randrange(1, 12))] for k in range(edges)}


def _as_events(lists):
    return [obs(f"{k}-{i}", f"s{k}>t{k}", lat, ts) if kind == "o" else rem(f"{k}-{i}", f"s{k}>t{k}", ts) for k, events in lists.items() for i, (kind, ts, lat) in enumerate(events)]


def test_fold_against_model(spark):
    lists = _random_lists(7, 150)
    events = read_batch(spark, json.dumps(_as_events(lists)))
    got = {int(r["source"][1:]): (r["live"], r["n"], round(r["avg"], 9), r["stale_obs"], r["stale_rem"], r["unknown_rem"]) for r in edge_state(events).collect()}
    assert got == {k: model(v) for k, v in lists.items()}
    assert {r["source"] for r in live_topology(events).collect()} == {f"s{k}" for k, v in lists.items() if model(v)[0]}


def test_restart_equals_one_batch(spark, tmp_path):
    lists = _random_lists(11, 40)
    events = read_batch(spark, json.dumps(_as_events(lists)))
    n = events.count()
    store = Store(spark, f"file://{tmp_path}/state")
    cut = n // 2
    apply_batch(store, 0, events.where(F.col("arrival_seq") < cut))
    report = apply_batch(store, 1, events.where(F.col("arrival_seq") >= cut - 5))
    assert report["duplicates_before"] == 5 and apply_batch(store, 1, events)["skipped"]
    got = {int(r["source"][1:]): (r["live"], r["n"], round(r["avg"], 9), r["stale_obs"], r["stale_rem"], r["unknown_rem"]) for r in store.load().edge_state.collect()}
    assert got == {k: model(v) for k, v in lists.items()}
    assert Engine.from_store(store).counts().first()["edge_count"] == sum(model(v)[0] for v in lists.values())


def test_stream_and_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([obs(1, "a>b"), obs(2, "b>c"), obs(3, "c>d", status="OK")]))
    store = Store(spark, f"file://{tmp_path}/state")
    run = lambda: stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination(120)
    run()
    (tmp_path / "in/b.json").write_text(json.dumps([obs(1, "a>b", 99), rem(4, "b>c", 50)]))
    run()
    e = Engine.from_store(store)
    assert [tuple(r)[:4] for r in e.edges.collect()] == [("a", "b", 10.0, 1)]
    assert spark.read.parquet(f"file://{tmp_path}/state/quarantine").count() == 1


def test_intake(spark, tmp_path):
    intake = Intake(Store(spark, f"file://{tmp_path}/s"), IngestConfig(max_events_per_trigger=2, on_overflow="shed"))
    batch = read_batch(spark, json.dumps([obs(i, "a>b") for i in range(3)]))
    assert intake.offer(batch) == {"submitted": 3, "accepted": 2, "rejected": 1}
    intake.close()
    with pytest.raises(PipelineClosed):
        intake.offer(batch)
    assert intake.drain()["applied"] == 2 and intake.metrics()["size"] == 0


def test_tools(spark):
    e = graph(spark, "a>b b>a")
    assert call(e, "reachable", {"service": "a"})["content"][0]["id"] == "b"
    assert call(e, "critical_services", {"k": 0})["isError"] and call(e, "nothing")["isError"]
    assert call(e, "reachable", {"service": "zz"})["content"]["error"] == "service_not_found"
    assert call(e, "health", {"service": "a", "as_of": "2026-05-10T12:00:05"})["content"][0]["sample_count"] == 2


def test_generator(spark):
    c = GeneratorConfig(services=50, events=2000, hubs=3, cycles=2)
    a, b = generator.events(spark, c), generator.events(spark, c)
    assert a.count() == 2000
    share = dict(a.groupBy("type").count().collect())
    assert 0.72 < share["dependency_observed"] / 2000 < 0.84
    seen = a.where("type = 'dependency_observed'")
    assert 0.02 < seen.where("status <> 'ok'").count() / seen.count() < 0.10
    assert a.select("event_id").distinct().count() < 2000
    assert a.select(F.sum(F.xxhash64("arrival_seq", "event_id", "source") % 1000003).cast("string")).first() == b.select(F.sum(F.xxhash64("arrival_seq", "event_id", "source") % 1000003).cast("string")).first()
    with pytest.raises(InvalidRequest):
        GeneratorConfig(error_rate=2)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10


def test_samples_of_a_busy_edge(spark, tmp_path):
    """An edge of 1,500 observations, and one that was removed and came back with 1,300: no buffer's cap in the queries of samples."""
    duckdb = pytest.importorskip("duckdb")
    from tidegraph import queries as Q

    start = dt.datetime(2024, 1, 30)
    events = [(i, start + dt.timedelta(seconds=i), "error" if i % 7 == 0 else "click", float(i % 90), i % 2, '{"k": 10}') for i in range(3000)]
    events[399] = (399, events[399][1], "signup", 1.0, 1, '{"k": 10}')
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, event_type string, value double, user_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("tumbling_health", "restored_samples", "health_all_services", "health_service", "health_edges"):
        got = getattr(Q, name)(spark, str(tmp_path))
        want = con.execute(Q.SQL[name]).df()[got.columns]
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.itertuples(index=False, name=None))), name
        assert name != "restored_samples" or got.count() == 1500 + 1300


def test_files_that_are_no_arrays(spark, tmp_path):
    """Truncated files, single objects and null items are not lost, in batch and in the stream; places do not overlap."""
    good = lambda *ids: json.dumps([obs(i, "a>b", i, 0) for i in ids])
    for name, text in {"a": good(1, 2, 3), "b": '[{"type": "dependency_obs', "c": json.dumps(obs(9, "x>y")), "d": "[null, " + good(4)[1:], "e": "[]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    events, bad = read_files(spark, f"file://{tmp_path}")
    assert [r["event_id"] for r in events.orderBy("arrival_seq").collect()] == ["e1", "e2", "e3", "e4"]
    assert sorted(r["fault"] for r in bad.collect()) == ["malformed", "not an array", "not an array"]
    seqs = [r["arrival_seq"] for r in events.select("arrival_seq").unionByName(bad.select("arrival_seq")).collect()]
    assert len(set(seqs)) == 7
    store = Store(spark, f"file://{tmp_path}/state")
    stream(spark, f"{tmp_path}/*.json", store, f"{tmp_path}/check", clock=lambda: NOW).awaitTermination(120)
    assert store.processed_count() == 4 and spark.read.parquet(f"file://{tmp_path}/state/quarantine").count() == 3


def test_stream_prunes_by_age(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([obs(1, "a>b", 10, -900), obs(2, "a>b", 20, -10), rem(3, "c>d", 0), obs(4, "c>d", 5, -301), obs(5, "c>d", 5, 1)]))
    store = Store(spark, f"file://{tmp_path}/state")
    stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check"), clock=lambda: NOW).awaitTermination(120)
    assert [(r["source"], r["place"], r["latency_ms"]) for r in store.samples().collect()] == [("a", 0, 20), ("c", 0, 5)]
    assert Engine.from_store(store).edges.where("source = 'a'").first()["sample_count"] == 2


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    events = read_batch(spark, json.dumps([obs(1, "a>b")]))
    apply_batch(store, 0, events)
    state = store.load()
    with pytest.raises(InvalidRequest, match="committed already"):
        store.commit(0, state.nodes.limit(0), state.edge_state.limit(0), state.processed)
    assert store.load().edge_state.count() == 1


def test_store_merges_and_tidies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidegraph.sources.store.MOST_LISTS", 2)
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(5):
        apply_batch(store, k, read_batch(spark, json.dumps([obs(k, "a>b"), obs(k + 1, "a>b")]), 10 * k))
    assert store.processed_count() == 6 and store.load().edge_state.first()["n"] == 6
    assert len(store._pointer(4)["processed"]) <= 2 and len(list(tmp_path.glob("s/v=*/edge_state"))) == 2


def test_hot_edge_streams(spark):
    """One edge with 200,000 events and a removal early on: only its state and its last samples are held."""
    n = 200_000
    events = spark.range(n).select(
        F.col("id").alias("arrival_seq"), F.when(F.col("id") == 10, "dependency_removed").otherwise("dependency_observed").alias("type"), F.col("id").cast("string").alias("event_id"),
        F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("source"), F.lit("b").alias("target"), (F.col("id") % 100).cast("int").alias("latency_ms"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("map<string,string>").alias("attributes"),
    )
    r = edge_state(events.repartition(7)).collect()
    assert len(r) == 1 and r[0]["n"] == n - 11 and len(r[0]["samples"]) == 1024 and r[0]["samples"][-1]["latency_ms"] == (n - 1) % 100


def test_dense_component(spark):
    """All cycles of a complete graph of six nodes, and none of the edges between components."""
    e = graph(spark, " ".join(f"{a}>{b}" for a in "abcdef" for b in "abcdef" if a != b) + " f>g g>h h>g z>a")
    found = cycles(e)
    assert len(found) == 409 + 1 and ["g", "h", "g"] in found and found == sorted(found, key=lambda c: (len(c), c))


def test_tool_defaults(spark):
    e = graph(spark, "a>b")
    assert call(e, "health", {"service": "a"})["content"][0]["sample_count"] == 0  # of the last 300 seconds
    assert call(e, "reachable", {"service": 3})["content"]["message"] == "parameter 'service' has the wrong type"
    e.nodes = None
    assert call(e, "reachable", {"service": "a"})["content"] == {"error": "internal_error", "message": "an unexpected error occurred"}


def test_steps_beyond_the_driver(spark, monkeypatch):
    monkeypatch.setattr("tidegraph.scratch.MOST_HELD", 1)
    e = graph(spark, "a>b b>c c>a b>d d>b")
    assert cycles(e) == [["b", "d", "b"], ["a", "b", "c", "a"]] and len(paths(e.reachable("a"))) == 4


def _long_edges(spark):
    """Sixteen edges of 128 observations, in order of arrival; the averages by the state machine's own steps."""
    rng, rows, want = random.Random(3), [], {}
    for e in range(16):
        avg = 0.0
        for n in range(128):
            x = rng.randrange(1, 400)
            avg += (x - avg) / (n + 1)
            rows.append((n * 16 + e, "dependency_observed", f"e{n}-{e}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=n * 16 + e), f"s{e}", "t", x, "ok", None, None))
        want[f"s{e}"] = avg
    return spark.createDataFrame(rows, EVENTS), want


def test_average_of_two_batches(spark):
    """The first batch's average has the last bits of the rolling one, so that ties round alike."""
    events, want = _long_edges(spark)
    first = edge_state(events.where("arrival_seq < 1024"))
    assert {r["source"]: r["avg"] for r in edge_state(events.where("arrival_seq >= 1024"), first).collect()} == want


def test_average_in_the_store(spark, tmp_path):
    events, want = _long_edges(spark)
    store = Store(spark, f"file://{tmp_path}/s")
    apply_batch(store, 0, events.where("arrival_seq < 1024"))
    apply_batch(store, 1, events)
    assert {r["source"]: r["avg"] for r in store.load().edge_state.collect()} == want


def test_files_of_the_stream_are_bounded(spark, monkeypatch, tmp_path):
    """Four parts of several files each, two triggers: the state of all events in order, and no file of more than FILE_EVENTS places."""
    sf = "/root/testdata/sf0.001"
    want = sorted(ingest_queries.edges_of_two_batches(spark, sf).collect())
    monkeypatch.setattr(ingest_queries, "FILE_EVENTS", 60)
    monkeypatch.setattr(ingest_queries, "_own_folder", lambda spark, name: f"file://{tmp_path}/{name}")
    assert sorted(ingest_queries.stream_edges(spark, sf).collect()) == want
    files = [json.loads(p.read_text()) for p in tmp_path.glob("incoming/*/*/part-*")]
    assert len(files) % 4 == 0 and 0 < max(map(len, files)) <= 60 and sum(map(len, files)) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(list(tmp_path.glob("streamed/committed/[0-9]*"))) == 2


def test_prior_state_meets_its_events_where_joins_are_planned_anew(spark, tmp_path):
    """The second batch's join with the edges' counts is read by mapper once the counts are known to be small; an edge's prior state still comes to the task of its events."""
    k = F.col("id")
    edge = (k % 10).cast("string")
    events = spark.range(0, 20_000, 1, 4).select(
        F.concat(F.lit("e-"), "id").alias("event_id"), F.when(k % 50 == 49, "dependency_removed").otherwise("dependency_observed").alias("type"), F.timestamp_seconds(k).alias("ts"), F.concat(F.lit("s"), edge).alias("source"),
        F.concat(F.lit("t"), edge).alias("target"), F.lit(5).alias("latency_ms"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("map<string,string>").alias("attributes"), k.alias("arrival_seq"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10k")
    try:
        store = Store(spark, f"file://{tmp_path}/s")
        apply_batch(store, 0, events.where("arrival_seq < 10000"))
        apply_batch(store, 1, events)
        got = sorted((r["source"], r["n"], r["live"]) for r in store.load().edge_state.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the tenth edge: four observations after each removal, the last event removes it
    assert got == [(f"s{i}", 2000, True) for i in range(9)] + [("s9", 4, False)]
