"""Tables of the engine."""

from pyspark.sql import types as T

STATUSES = ("ok", "error", "timeout")
OBSERVED, REMOVED, METADATA, HEARTBEAT = "dependency_observed", "dependency_removed", "service_metadata", "heartbeat"

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "map": T.MapType(T.StringType(), T.StringType())}


def _table(fields: str, **more: T.DataType) -> T.StructType:
    pairs = [f.split() for f in fields.split(", ")]
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in pairs] + [T.StructField(n, k) for n, k in more.items()])


SAMPLE = _table("ts timestamp, latency_ms int, status string")
#: An event as it arrives; arrival_seq is its place in the order of arrival.
EVENT = _table("type string, event_id string, timestamp timestamp, source string, target string, latency_ms int, status string, service string, attributes map")
EVENTS = _table("arrival_seq bigint, type string, event_id string, ts timestamp, source string, target string, latency_ms int, status string, service string, attributes map")
EDGE_STATE = _table("source string, target string, live boolean, last_obs timestamp, n bigint, avg double, tombstone timestamp, stale_obs bigint, stale_rem bigint, unknown_rem bigint, accepted boolean", samples=T.ArrayType(SAMPLE))
NODES = _table("id string, team string, tier string, region string, last_heartbeat timestamp")
PROCESSED = _table("event_id string")
