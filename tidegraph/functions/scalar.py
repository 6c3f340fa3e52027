"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_blank(c: Column) -> Column:
    """Whether a string holds anything but Unicode white space; false for null."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def edge_key(source: Column, target: Column) -> Column:
    """One string for an ordered pair; the unit separator does not occur in ids."""
    return F.concat_ws("\u001f", source, target)


def route(key: Column, partitions: int) -> Column:
    """The partition of a key: all events of an edge, or of a service, meet in one. Of the first 32 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % partitions).cast("int")


def route_key(events_type: Column, source: Column, target: Column, service: Column) -> Column:
    return F.when(events_type.isin("dependency_observed", "dependency_removed"), edge_key(source, target)).otherwise(service)


def nearest_rank(c: Column | str, share: float) -> Column:
    """Exact percentile by nearest rank: the value at place ceil(share * n) of the sorted values."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {c})")


def path_text(path: Column) -> Column:
    return F.concat_ws(">", path)
