"""The test tables of orders and events seen as spans."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.ids import hex_id
from spanloom.runtime import table
from spanloom.sources.schema import PROMOTED, RESOURCE_TERMS, SPAN_SCHEMA, variant_map

_KINDS = dict(x.strip().split(" ", 1) for x in SPAN_SCHEMA.replace(", ", "\n").split("\n"))


def ns(c: str):
    """Nanoseconds since 1970 of a time without zone, in any session zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c)) * 1000


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("long") * 10_000


def order_spans(spark: SparkSession, d: str, piece: tuple[int, int] | None = None) -> DataFrame:
    """Orders as root spans, their lines as children, with promoted columns. piece:
    (i, n) for the i-th of n pieces, with whole traces in each."""
    def part(name: str, key: str) -> DataFrame:
        t = table(spark, d, name)
        return t if piece is None else t.where(F.pmod(F.xxhash64(key), F.lit(piece[1])) == piece[0])

    o = part("orders", "o_orderkey").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    st = F.col("o_orderstatus")
    roots = o.select(
        hex_id(key, 32).alias("trace_id"),
        hex_id(key * 16, 16).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("order "), F.lower("o_orderpriority")).alias("name"),
        F.lit("server").alias("kind"),
        ns("o_orderdate").alias("start_time"),
        _cents("o_totalprice").alias("duration_ns"),
        F.when(st == "F", "ok").when(st == "P", "error").otherwise("unset").alias("status"),
        F.when(st == "P", "partial order").alias("status_message"),
        F.lower("c_mktsegment").alias("a_service"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "POST").otherwise("GET").alias("a_method"),
        F.when(st == "F", 200).when(st == "P", 500).otherwise(202).cast("long").alias("a_code"),
        F.lit(None).cast("string").alias("a_db"),
        F.lit("gateway").alias("r_service"),
        F.concat(F.lit("host-"), (F.col("o_custkey") % 5).cast("string")).alias("r_host"),
    )
    roots = roots.withColumn("attributes", variant_map(service__name=F.col("a_service"), http__method=F.col("a_method"), http__status_code=F.col("a_code")))
    flag = F.col("l_returnflag")
    lines = part("lineitem", "l_orderkey").select(
        hex_id(F.col("l_orderkey"), 32),
        hex_id(F.col("l_orderkey") * 16 + F.col("l_linenumber"), 16),
        hex_id(F.col("l_orderkey") * 16, 16),
        F.concat(F.lit("line "), F.lower("l_returnflag")),
        F.when(F.col("l_linenumber") % 2 == 0, "client").otherwise("internal"),
        ns("l_shipdate"),
        _cents("l_extendedprice"),
        F.when(F.col("l_linestatus") == "F", "ok").otherwise("unset"),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        F.lit(None).cast("string"),
        F.lit(None).cast("long"),
        F.when(flag == "A", "postgresql").when(flag == "N", "redis").otherwise("mysql").alias("a_db"),
        F.concat(F.lit("supplier-"), (F.col("l_suppkey") % 10).cast("string")),
        F.concat(F.lit("host-"), (F.col("l_partkey") % 5).cast("string")),
    )
    s = roots.union(lines.withColumn("attributes", variant_map(db__system=F.col("a_db"))))
    none = F.lit(None).cast("string")
    promoted = {
        "service.name": F.coalesce("a_service", "r_service"),
        "host.name": F.col("r_host"),
        "http.method": F.col("a_method"),
        "http.status_code": F.col("a_code").cast("string"),
        "db.system": F.col("a_db"),
    }
    return s.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "name",
        "kind",
        "start_time",
        (F.col("start_time") + F.col("duration_ns")).alias("end_time"),
        "duration_ns",
        "status",
        "status_message",
        "attributes",
        F.array().cast(_KINDS["events"]).alias("events"),
        variant_map(service__name=F.col("r_service"), host__name=F.col("r_host")).alias("resource"),
        F.lit(None).cast(_KINDS["instrumentation_scope"]).alias("instrumentation_scope"),
        *(promoted.get(k, none).alias(c) for k, c in PROMOTED.items()),
        *((F.col("r_host") if k == "host.name" else none).alias(c) for k, c in RESOURCE_TERMS.items()),
    )


def event_spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans: a user's events are a trace under its first event."""
    e = table(spark, d, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    service = F.concat(F.lit("shard-"), (F.col("user_id") % 4).cast("string"))
    k = F.get_json_object("props", "$.k")
    none = F.lit(None).cast("string")
    e = e.select(
        hex_id(F.col("user_id"), 32).alias("trace_id"),
        hex_id(F.col("event_id"), 16).alias("span_id"),
        F.when(F.row_number().over(w) > 1, hex_id(F.first("event_id").over(w), 16)).alias("parent_span_id"),
        kind.alias("name"),
        F.when(kind == "view", "server").when(kind == "click", "client").when(kind == "signup", "producer").when(kind == "purchase", "consumer").otherwise("internal").alias("kind"),
        ns("ts").alias("start_time"),
        _cents("value").alias("duration_ns"),
        F.when(kind == "error", "error").when(kind == "purchase", "ok").otherwise("unset").alias("status"),
        none.alias("status_message"),
        variant_map(k=k).alias("attributes"),
        F.array(F.struct(kind.alias("name"), ns("ts").alias("timestamp"), variant_map(k=k).alias("attributes"))).cast(_KINDS["events"]).alias("events"),
        variant_map(service__name=service).alias("resource"),
        F.lit(None).cast(_KINDS["instrumentation_scope"]).alias("instrumentation_scope"),
        *((service if c == "service_name" else none).alias(c) for c in PROMOTED.values()),
        *(none.alias(c) for c in RESOURCE_TERMS.values()),
    )
    return e.withColumn("end_time", F.col("start_time") + F.col("duration_ns"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(no: int, v: int | bytes | str) -> bytes:
    if isinstance(v, int):
        return _varint(no << 3) + _varint(v)
    v = v.encode() if isinstance(v, str) else v
    return _varint(no << 3 | 2) + _varint(len(v)) + v


def _time(no: int, ns: int) -> bytes:
    return _varint(no << 3 | 1) + struct.pack("<Q", ns)


def _pair(no: int, key: str, v: int | str | None) -> bytes:
    return b"" if v is None else _field(no, _field(1, key) + _field(2, _field(3 if isinstance(v, int) else 1, v)))


def _request(r: dict) -> bytes:
    """One span as a binary trace request of its own."""
    s = _field(1, bytes.fromhex(r["trace_id"])) + _field(2, bytes.fromhex(r["span_id"]))
    if r["parent_span_id"]:
        s += _field(4, bytes.fromhex(r["parent_span_id"]))
    s += _field(5, r["name"]) + _field(6, {"internal": 1, "server": 2, "client": 3}[r["kind"]]) + _time(7, r["start_time"]) + _time(8, r["end_time"])
    s += _pair(9, "service.name", r["a_service"]) + _pair(9, "http.method", r["a_method"]) + _pair(9, "http.status_code", r["a_code"]) + _pair(9, "db.system", r["a_db"])
    s += _field(15, (_field(2, r["status_message"]) if r["status_message"] else b"") + _field(3, {"unset": 0, "ok": 1, "error": 2}[r["status"]]))
    resource = _pair(1, "service.name", r["r_service"]) + _pair(1, "host.name", r["r_host_name"])
    return _field(1, _field(1, resource) + _field(2, _field(1, _field(1, "lib")) + _field(2, s)))


def binary_requests(spans: DataFrame) -> DataFrame:
    """Spans as bodies of binary trace requests (requests put one after the other are
    one request); every second body is gzipped."""
    def text(c: str, key: str, kind: str = "string"):
        return F.col(c)[key].cast(kind)

    x = spans.select("trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "status", "status_message", "r_host_name", text("attributes", "service.name").alias("a_service"), text("attributes", "http.method").alias("a_method"),
                     text("attributes", "http.status_code", "bigint").alias("a_code"), text("attributes", "db.system").alias("a_db"), text("resource", "service.name").alias("r_service"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(map(_request, b.to_pylist()))
            bodies = [b"".join(rows[k : k + 100]) for k in range(0, len(rows), 100)]
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 1) if k % 2 else x for k, x in enumerate(bodies)], pa.binary())], ["body"])

    return x.mapInArrow(run, "body binary")
