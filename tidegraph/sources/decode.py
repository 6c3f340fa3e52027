"""Decoding and validation of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest
from ..functions.scalar import not_blank
from ..schemas import EVENT, HEARTBEAT, METADATA, OBSERVED, REMOVED, STATUSES

_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z$"


def _fault(e: Column, raw: Column) -> Column:
    """What is wrong with a decoded event, null if nothing is."""
    edge = e["type"].isin(OBSERVED, REMOVED)
    stamp, latency = e["timestamp"], F.get_json_object(raw, "$.latency_ms")
    return (
        F.when(e.isNull() | e["_corrupt"].isNotNull(), "malformed")
        .when(e["type"].isNull() | ~e["type"].isin(OBSERVED, REMOVED, METADATA, HEARTBEAT), "unknown type")
        .when(stamp.isNull() | ~stamp.rlike(_INSTANT) | F.try_to_timestamp(stamp).isNull(), "bad timestamp")
        .when(edge & ~(not_blank(e["source"]) & not_blank(e["target"])), "missing endpoint")
        .when(~edge & ~not_blank(e["service"]), "missing service")
        .when((e["type"] == OBSERVED) & ~F.coalesce(e["status"].isin(*STATUSES), F.lit(False)), "bad status")
        .when((e["type"] == OBSERVED) & latency.isNotNull() & e["latency_ms"].isNull(), "bad latency")
        .when((e["type"] == OBSERVED) & (e["latency_ms"] < 0), "negative latency")
    )


def decode(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of rows arrival_seq, value (a JSON object). Events of a blank id are dropped silently.

    An observation without latency_ms has latency 0. Everything else that the schema forbids goes to the quarantine,
    with its fault.
    """
    fields = [T.StructField(f.name, T.StringType()) if f.name == "timestamp" else f for f in EVENT.fields]
    schema = T.StructType([*fields, T.StructField("_corrupt", T.StringType())])
    parsed = raw.withColumn("e", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    judged = parsed.withColumn("fault", _fault(F.col("e"), F.col("value")))
    good = judged.where(F.col("fault").isNull() & not_blank(F.col("e.event_id")))
    latency = F.when(F.col("e.type") == OBSERVED, F.coalesce("e.latency_ms", F.lit(0)))
    events = good.select("arrival_seq", "e.type", "e.event_id", F.try_to_timestamp("e.timestamp").alias("ts"), "e.source", "e.target", latency.alias("latency_ms"), "e.status", "e.service", "e.attributes")
    return events, judged.where(F.col("fault").isNotNull()).select("arrival_seq", "value", "fault")


def read_batch(spark: SparkSession, text: str, first_seq: int = 0) -> DataFrame:
    """Events of one request body, a JSON object or array. One bad event rejects all of them."""
    import json

    try:
        body = json.loads(text)
    except ValueError:
        raise InvalidRequest("malformed request body") from None
    items = body if isinstance(body, list) else [body]
    raw = spark.createDataFrame([(first_seq + i, json.dumps(x)) for i, x in enumerate(items)], "arrival_seq bigint, value string")
    events, bad = decode(raw)
    if bad.limit(1).count():
        raise InvalidRequest("malformed request body")
    return events


def decode_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of rows file, value: the text of each file, an array of events.

    The order of arrival is by file name, then place: a file's first place is the number of places in the files before it,
    a running sum over one row a file. A file that is no JSON array, and an item that is null, go to the quarantine; an
    empty array has no events.
    """
    parsed = files.select("file", "value", F.from_json("value", "array<string>").alias("items"))
    whole = parsed.select("file", F.when(F.size("items") >= 0, F.col("items")).otherwise(F.array("value")).alias("items"), (F.col("items").isNotNull()).alias("is_array"))
    places = files.select("file", F.greatest(F.coalesce(F.size(F.from_json("value", "array<string>")), F.lit(1)), F.lit(1)).alias("n"))
    first = places.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("first"))
    rows = whole.select("file", "is_array", F.posexplode("items").alias("pos", "value")).join(first, "file")
    rows = rows.select((F.col("first") + F.col("pos")).alias("arrival_seq"), "value", "is_array")
    events, bad = decode(rows.where("is_array").drop("is_array"))
    return events, bad.unionByName(rows.where("not is_array").select("arrival_seq", "value", F.lit("not an array").alias("fault")))


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of files that hold an array of events each; the order is by file name, then place."""
    return decode_files(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))
