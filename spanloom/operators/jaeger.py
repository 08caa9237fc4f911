"""Traces in the shape of the Jaeger query interface."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.search import page

_INT = re.compile(r"[+-]?\d+")
_UNITS = (("ms", 1_000_000), ("us", 1_000), ("s", 1_000_000_000))


def duration_ns(s: str) -> int:
    """Nanoseconds of 100us, 2ms or 3s; a number without unit is nanoseconds. Only
    whole digits at the start count; a unit without any is a ValueError."""
    for unit, factor in _UNITS:
        if s.endswith(unit):
            m = _INT.match(s)
            if not m:
                raise ValueError(f"duration: {s}")
            return int(m[0]) * factor
    m = _INT.match(s)
    return int(m[0]) if m else 0


def search_filters(params: Mapping[str, str]) -> list[tuple[str, object]]:
    """Conditions of a search request: service, operation, start and end in
    microseconds, limit, minDuration, maxDuration. Other parameters, and
    numbers that aren't, are ignored."""
    out: list[tuple[str, object]] = []
    for key, name in (("service", "service"), ("operation", "name")):
        if params.get(key) is not None:
            out.append((name, params[key]))
    for key, name, factor in (("start", "since", 1000), ("end", "until", 1000), ("limit", "limit", 1)):
        m = _INT.match(params.get(key) or "")
        if m:
            out.append((name, int(m[0]) * factor))
    for key, name in (("minDuration", "min_duration"), ("maxDuration", "max_duration")):
        if params.get(key) is not None:
            out.append((name, duration_ns(params[key])))
    return out


def micros(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.call_function("div", c, F.lit(1000).cast("long"))


def service(c: str = "service_name") -> Column:
    return F.coalesce(F.col(c), F.lit("unknown"))


def tag_type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return F.when(t == "BIGINT", "int64").when((t == "DOUBLE") | t.startswith("DECIMAL") | (t == "FLOAT"), "float64").when(t == "BOOLEAN", "bool").otherwise("string")


def _tag(k: Column, t: Column, v: Column) -> Column:
    return F.struct(k.alias("key"), t.alias("type"), v.alias("value"))


def _fixed(key: str, v: Column) -> Column:
    return _tag(F.lit(key), F.lit("string"), v.cast("variant"))


def map_tags(m: Column) -> Column:
    return F.transform(F.map_entries(m), lambda e: _tag(e["key"], tag_type(e["value"]), e["value"]))


def span_tags() -> Column:
    base = F.array(_fixed("span.kind", F.col("kind")), _fixed("otel.status_code", F.upper("status")))
    message = F.when(F.col("status_message").isNotNull(), F.array(_fixed("otel.status_description", F.col("status_message")))).otherwise(F.slice(base, 1, 0))
    return F.concat(base, message, map_tags(F.col("attributes")))


def logs() -> Column:
    def one(e: Column) -> Column:
        first = F.array(_fixed("event", F.coalesce(e["name"], F.lit(""))))
        rest = F.coalesce(map_tags(e["attributes"]), F.slice(first, 1, 0))
        return F.struct(F.coalesce(micros(e["timestamp"]), F.lit(0).cast("long")).alias("timestamp"), F.concat(first, rest).alias("fields"))

    return F.transform("events", one)


def references() -> Column:
    ref = F.array(F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").alias("spanID")))
    return F.when(F.col("parent_span_id").isNotNull(), ref).otherwise(F.slice(ref, 1, 0))


def processes(spans: DataFrame) -> DataFrame:
    """trace_id, service, process_id (p1, p2, ... by name of service)."""
    s = spans.select("trace_id", service().alias("service")).distinct()
    return s.withColumn("process_id", F.concat(F.lit("p"), F.dense_rank().over(W.partitionBy("trace_id").orderBy("service")).cast("string")))


def process_tags(spans: DataFrame) -> DataFrame:
    """trace_id, service, key, type, value: resource entries of the spans of a trace
    and service, but for service.name; of entries with one key the latest span's counts."""
    r = spans.select("trace_id", service().alias("service"), F.struct("start_time", "span_id").alias("at"), F.explode("resource").alias("key", "v")).where("key <> 'service.name'")
    r = r.withColumn("at", F.struct("at", F.col("v").cast("string")))
    last = r.groupBy("trace_id", "service", "key").agg(F.max_by("v", "at").alias("v"))
    return last.select("trace_id", "service", "key", tag_type(F.col("v")).alias("type"), F.col("v").alias("value"))


def jaeger_spans(spans: DataFrame) -> DataFrame:
    """One row per span with the ten fields of the interface and trace_id, start_time."""
    p = processes(spans).withColumnRenamed("service", "_service")
    s = spans.withColumn("_service", service()).join(p, ["trace_id", "_service"])
    return s.select(
        "trace_id",
        "start_time",
        F.struct(
            F.col("trace_id").alias("traceID"),
            F.col("span_id").alias("spanID"),
            F.col("name").alias("operationName"),
            references().alias("references"),
            micros("start_time").alias("startTime"),
            micros("duration_ns").alias("duration"),
            span_tags().alias("tags"),
            logs().alias("logs"),
            F.col("process_id").alias("processID"),
            F.lit(None).cast("string").alias("warnings"),
        ).alias("span"),
    )


def _by_start(a: Column, b: Column) -> Column:
    """Order of a document's spans; ties of time and identifier are broken, too."""
    out = F.lit(0)
    for c in ("processID", "operationName", "duration", "spanID", "startTime"):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def jaeger_traces(spans: DataFrame) -> DataFrame:
    """trace_id and the trace as JSON. A trace is one document of the interface, so
    its spans meet in one row: for a search's page or one trace, not for a store."""
    got = jaeger_spans(spans).groupBy("trace_id").agg(F.array_sort(F.collect_list("span"), _by_start).alias("spans"))
    tags = process_tags(spans).groupBy("trace_id", "service").agg(F.array_sort(F.collect_list(F.struct("key", "type", "value")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("tags"))
    proc = processes(spans).join(tags, ["trace_id", "service"], "left")
    none = F.array().cast("array<struct<key:string,type:string,value:variant>>")
    one = F.struct(F.col("service").alias("serviceName"), F.coalesce("tags", none).alias("tags"))
    proc = proc.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("process_id", one))).alias("processes"))
    doc = F.struct(F.col("trace_id").alias("traceID"), "spans", "processes", F.lit(None).cast("string").alias("warnings"))
    return got.join(proc, "trace_id").select("trace_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json")).orderBy("trace_id")


def search(spans: DataFrame, params: Mapping[str, str], limit_by: str = "span") -> DataFrame:
    """Traces of a search's page. limit counts spans, so a trace may be partial;
    with limit_by trace it counts whole traces, those of the latest matches first."""
    filters = search_filters(params)
    if limit_by == "span":
        return jaeger_traces(page(spans, filters))
    from spanloom.operators.filters import split, where

    p, conds = split(filters)
    latest = where(spans, conds).groupBy("trace_id").agg(F.max("start_time").alias("m")).orderBy(F.col("m").desc(), "trace_id").limit(int(p.get("limit", 100)))
    return jaeger_traces(spans.join(latest.select("trace_id"), "trace_id", "left_semi"))


def envelope(traces: list[str]) -> str:
    return '{"data":[' + ",".join(traces) + f'],"errors":null,"limit":0,"offset":0,"total":{len(traces)}}}'


def name_list(names: list[str]) -> str:
    import json

    return json.dumps({"data": names, "errors": None, "limit": 0, "offset": 0, "total": len(names)})
