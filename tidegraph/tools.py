"""The engine's questions as named tools with JSON arguments and answers."""

from __future__ import annotations

import datetime as dt
import json
import logging

from pyspark.sql import functions as F

from .engine import Engine
from .errors import EngineError, InvalidRequest

log = logging.getLogger(__name__)
_TEXT, _COUNT = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 1, "maximum": 1000}


def _schema(**fields) -> dict:
    return {"type": "object", "properties": fields, "required": [k for k, v in fields.items() if "default" not in v]}


TOOLS = {
    "reachable": ("Services that a service depends on, directly or not, each with a path", _schema(service=_TEXT)),
    "dependents": ("Services that depend on a service, directly or not, each with a path", _schema(service=_TEXT)),
    "shortest_path": ("The way between two services with the least latency", _schema(source=_TEXT, target=_TEXT)),
    "critical_services": ("The services with the highest in-degree times out-degree", _schema(k=_COUNT | {"default": 10})),
    "cycles": ("All elementary cycles", _schema()),
    "health": ("Error rate and 95th percentile of latency over the last seconds before as_of, the present if not given", _schema(service=_TEXT, as_of=_TEXT | {"default": None}, window_seconds={"type": "integer", "minimum": 1, "default": None})),
}


def _checked(name: str, given: dict) -> dict:
    if name not in TOOLS:
        raise InvalidRequest(f"no such tool: {name}")
    fields, out = TOOLS[name][1]["properties"], {}
    if unknown := set(given) - set(fields):
        raise InvalidRequest(f"invalid arguments: {sorted(unknown)}")
    for key, rule in fields.items():
        value = given.get(key, rule.get("default"))
        if value is None and "default" in rule:
            continue
        if value is None:
            raise InvalidRequest(f"invalid arguments: {key}")
        if not isinstance(value, {"string": str, "integer": int}[rule["type"]]) or isinstance(value, bool):
            raise InvalidRequest(f"parameter '{key}' has the wrong type")
        if value == "" or rule["type"] == "integer" and (value < rule["minimum"] or value > rule.get("maximum", value)):
            raise InvalidRequest(f"invalid arguments: {key}")
        out[key] = value
    return out


def call(engine: Engine, name: str, arguments: dict | None = None) -> dict:
    """{"content": rows} or {"isError": True, "content": envelope}."""
    try:
        given = _checked(name, arguments or {})
        if name == "health":
            given.setdefault("as_of", dt.datetime.now(dt.timezone.utc).isoformat())
            try:
                given["as_of"] = dt.datetime.fromisoformat(given["as_of"])
            except ValueError:
                raise InvalidRequest("invalid arguments: as_of") from None
        rows = getattr(engine, name)(**given)
        return {"content": [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()]}
    except EngineError as e:
        return {"isError": True, "content": e.envelope()}
    except Exception:
        log.exception("tool %s", name)  # the trace stays here
        return {"isError": True, "content": EngineError("an unexpected error occurred").envelope()}
