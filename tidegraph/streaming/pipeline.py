"""The streaming pipeline: micro-batches of events into versioned state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import HealthConfig, IngestConfig
from ..errors import PipelineClosed
from ..operators.ingest import edge_state, first_arrivals, merge_nodes
from ..scratch import kept
from ..sources.decode import decode_files
from ..sources.store import Store


def apply_batch(store: Store, version: int, events: DataFrame, health: HealthConfig = HealthConfig(), oldest=None) -> dict:
    """Fold deduplicated events into the state and commit it as this version; a version that is committed is skipped.

    Counts of applied events and duplicates come back. All or nothing: a batch that fails leaves no state behind. Samples
    before `oldest` go as the state is written.
    """
    state = store.load()
    if version <= state.version:
        return {"version": version, "skipped": True}
    events = kept(events)  # decoded once
    total, ids = events.agg(F.count(F.lit(1)), F.count_distinct("event_id")).first()
    fresh = kept(first_arrivals(events, state.processed))
    edges = kept(edge_state(fresh, state.edge_state, health.max_samples_per_edge, oldest))
    store.commit(version, merge_nodes(fresh, edges, state.nodes), edges, fresh.select("event_id"), oldest)
    applied = fresh.count()
    return {"version": version, "received": total, "applied": applied, "duplicates_in_batch": total - ids, "duplicates_before": ids - applied}


def stream(spark: SparkSession, folder: str, store: Store, checkpoint: str, config: IngestConfig = IngestConfig(), health: HealthConfig = HealthConfig(), available_now: bool = True, clock=None) -> StreamingQuery:
    """Files of JSON arrays in a folder, in order of their appearance (within one trigger, of their paths), through decode and apply_batch.

    The source is pulled, so a slow state holds back reading: nothing is dropped. Faulty events, and files that are no
    array, go to the folder quarantine beside the state; valid events of the same file are applied. Samples older than
    the health window by `clock` (the time now) go with each batch. A killed batch runs again from the checkpoint and is
    skipped if its version stands.
    """
    now = clock or (lambda: dt.datetime.now(dt.timezone.utc))

    def commit(batch: DataFrame, batch_id: int) -> None:
        events, bad = decode_files(batch.select("file", "value"))
        bad.write.mode("overwrite").parquet(f"{store.path}/quarantine/batch={batch_id}")
        apply_batch(store, batch_id, events, health, F.lit(now() - dt.timedelta(seconds=health.window_seconds)))

    source = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", config.max_files_per_trigger).load(folder)
    writer = source.select("value", F.col("_metadata.file_path").alias("file")).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{config.trigger_seconds} seconds")).start()


def batch_ack(ack: dict) -> tuple[int, dict]:
    """(202 if all events were accepted, else 503; the counts) as the HTTP interface would answer a batch."""
    return (202 if ack["accepted"] == ack["submitted"] else 503), ack


class Intake:
    """A bounded buffer in front of the state, for callers that push events.

    With on_overflow "shed", offer() stops at the first event that does not fit and counts it and all after it as rejected: the
    caller may offer the rest again. With "block", the buffer is drained into the state first, and nothing is refused. The
    buffer belongs to one caller and a drain is synchronous, so there is no wait with a timeout: room comes from drain() alone.
    """

    def __init__(self, store: Store, config: IngestConfig = IngestConfig(), health: HealthConfig = HealthConfig()):
        self.store, self.config, self.health = store, config, health
        self.waiting: list[DataFrame] = []
        self.size = self.accepted = self.rejected = 0
        self.closed = False

    def _room(self, n: int) -> bool:
        return self.size + n <= self.config.max_events_per_trigger

    def offer(self, events: DataFrame) -> dict:
        """submitted, accepted, rejected; the first events that fit, in order of arrival."""
        if self.closed:
            raise PipelineClosed("pipeline is closed")
        n = events.count()
        if not self._room(n) and self.config.on_overflow == "block":
            self.drain()
        fit = n if self.config.on_overflow == "block" else min(n, self.config.max_events_per_trigger - self.size)
        if fit:
            self.waiting.append(events.orderBy("arrival_seq").limit(fit) if fit < n else events)
        self.size += fit
        self.accepted += fit
        self.rejected += n - fit
        return {"submitted": n, "accepted": fit, "rejected": n - fit}

    def drain(self) -> dict | None:
        """Apply what waits as the next version; also after close()."""
        if not self.waiting:
            return None
        rows, self.waiting, self.size = self.waiting, [], 0
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.unionByName(r)
        return apply_batch(self.store, self.store.version() + 1, whole, self.health)

    def close(self) -> None:
        self.closed = True

    def metrics(self) -> dict:
        return {"size": self.size, "capacity": self.config.max_events_per_trigger, "remaining": self.config.max_events_per_trigger - self.size, "accepted": self.accepted, "rejected": self.rejected, "closed": self.closed}
