"""Spans as a tracing SDK holds them in memory."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.enums import KINDS
from spanloom.sources.otlp import FLAT, variant_fields

#: The SDK's numbers of status codes.
_STATUS = {0: "unset", 1: "ok", 2: "error"}


def _hex(n: Any, width: int) -> str | None:
    return None if not n else f"{n:0{width}x}" if isinstance(n, int) else str(n)


def _enum(v: Any) -> Any:
    return getattr(v, "value", v)


def _plain(v: Any) -> Any:
    return v if isinstance(v, (str, int, float, bool)) else json.dumps(v, default=str)


def _map(m: Any) -> str:
    return json.dumps({str(k): _plain(v) for k, v in dict(m or {}).items()})


def record(s: Any) -> dict:
    """One finished span of the SDK's interface (context, parent, name, kind, times in
    nanoseconds, status, attributes, events, resource, instrumentation_scope) as a flat row."""
    kind, status = _enum(s.kind), s.status
    code = _enum(status.status_code)
    scope = getattr(s, "instrumentation_scope", None)
    events = [{"name": e.name, "timestamp": e.timestamp, "attributes": {str(k): _plain(v) for k, v in dict(e.attributes or {}).items()}} for e in s.events or ()]
    return {
        "trace_id": _hex(s.context.trace_id, 32),
        "span_id": _hex(s.context.span_id, 16),
        "parent_span_id": _hex(s.parent.span_id, 16) if s.parent is not None else None,
        "name": s.name,
        "kind": KINDS[kind] if isinstance(kind, int) and 0 <= kind < len(KINDS) else "internal",
        "start_time": s.start_time,
        "end_time": s.end_time,
        "duration_ns": (s.end_time or s.start_time) - s.start_time,
        "status": _STATUS.get(code, "unset"),
        "status_message": status.description or None,
        "attributes": _map(s.attributes),
        "events": json.dumps(events),
        "resource": _map(getattr(s.resource, "attributes", s.resource)),
        "scope": json.dumps({"name": scope.name, "version": scope.version or None}) if scope is not None else None,
    }


def from_sdk(spark: SparkSession, spans: Iterable[Any]) -> DataFrame:
    """Canonical spans of an exporter's batch. What isn't a span is left out silently,
    as an exporter must not disturb the program that it serves."""
    rows = []
    for s in spans:
        try:
            rows.append(record(s))
        except Exception:
            continue
    names = [x.split()[0] for x in FLAT.split(", ")]
    return variant_fields(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], FLAT))


class Exporter:
    """An SDK's exporter into an engine: export(spans), force_flush(), shutdown()."""

    def __init__(self, engine: Any):
        self._engine = engine

    def export(self, spans: Iterable[Any]) -> int:
        """How many spans were taken."""
        df = from_sdk(self._engine.spark, spans)
        return self._engine.ingest(df)

    def force_flush(self, timeout_millis: int = 30_000) -> bool:
        self._engine.flush()
        return True

    def shutdown(self) -> None:
        self._engine.flush()


def from_rest(rows: DataFrame, rest: str = "rest") -> DataFrame:
    """Canonical spans of the older columnar layout: plain columns, and one JSON text per
    row with status_message, attributes, events, resource and instrumentation_scope."""
    from pyspark.sql import functions as F

    def part(key: str, default: str) -> Any:
        return F.coalesce(F.get_json_object(rest, f"$.{key}"), F.lit(default))

    flat = rows.withColumns(
        {
            "status_message": F.get_json_object(rest, "$.status_message"),
            "attributes": part("attributes", "{}"),
            "events": part("events", "[]"),
            "resource": part("resource", "{}"),
            "scope": F.get_json_object(rest, "$.instrumentation_scope"),
        }
    )
    return variant_fields(flat)
