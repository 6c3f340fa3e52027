"""Versioned state: each commit writes a whole new version, then moves one pointer to it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..schemas import EDGE_STATE, NODES, PROCESSED


@dataclass
class State:
    nodes: DataFrame
    edge_state: DataFrame
    processed: DataFrame
    version: int = -1


#: So many lists of processed ids are kept apart; the next commit writes them as one.
MOST_LISTS = 16


class Store:
    """State tables in a folder that driver and executors share. Readers see the version that the newest pointer names.

    Each commit writes its tables to a folder of its own and then makes the pointer `committed/<version>`, a small file with
    the names of that folder and of the lists of processed ids. The pointer is made without overwriting: of two
    writers of one version the second is refused, and its tables are never read. A lost writer leaves tables
    without a pointer. State tables of versions before the last one go; lists of processed ids are merged from time to time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/committed")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def _pointer(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/committed/{version}", wholetext=True).first()[0])

    def load(self) -> State:
        v = self.version()
        if v < 0:
            return State(*(self.spark.createDataFrame([], schema) for schema in (NODES, EDGE_STATE, PROCESSED)), v)
        at = self._pointer(v)
        read = lambda schema, *folders: self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))
        return State(read(NODES, f"{at['state']}/nodes"), read(EDGE_STATE, f"{at['state']}/edge_state"), read(PROCESSED, *at["processed"]), v)

    def processed_count(self) -> int:
        """How many events have been applied, duplicates apart."""
        return self.load().processed.count()

    def samples(self, since: Column | None = None) -> DataFrame:
        """source, target, place, ts, latency_ms, status of the stored samples of live edges, from `since` on, by edge and place in the order of arrival."""
        state = self.load().edge_state.where("live")
        rows = state.select("source", "target", F.posexplode("samples").alias("place", "s")).select("source", "target", "place", "s.*")
        return (rows if since is None else rows.where(F.col("ts") >= since)).orderBy("source", "target", "place")

    def commit(self, version: int, nodes: DataFrame, edge_state: DataFrame, processed: DataFrame, keep_samples_from: Column | None = None) -> None:
        """processed: the ids of this version alone. Samples before keep_samples_from are pruned as the state is written.

        Raises InvalidRequest if another writer has committed this version.
        """
        before = self._pointer(self.version()) if self.version() >= 0 else {"state": None, "processed": []}
        if keep_samples_from is not None:
            edge_state = edge_state.withColumn("samples", F.filter("samples", lambda s: s["ts"] >= keep_samples_from))
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        lists = before["processed"]
        if len(lists) >= MOST_LISTS:
            processed, lists = processed.unionByName(self.spark.read.schema(PROCESSED).parquet(*(f"{self.path}/{f}" for f in lists))), []
        for name, df in (("nodes", nodes), ("edge_state", edge_state), ("processed", processed)):
            df.write.parquet(f"{self.path}/{folder}/{name}")
        fs, p = self._fs(f"{self.path}/committed/{version}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            raise InvalidRequest(f"version {version} is committed already") from None
        out.write(json.dumps({"state": folder, "processed": [*lists, f"{folder}/processed"]}).encode())
        out.close()
        self._tidy()

    def _tidy(self) -> None:
        """State tables go when two newer versions stand: a reader of the one before may still be at work."""
        done = self._versions()
        if len(done) > 2:
            old = self._pointer(done[-3])["state"]
            for name in ("nodes", "edge_state"):
                fs, p = self._fs(f"{self.path}/{old}/{name}")
                fs.delete(p, True)
