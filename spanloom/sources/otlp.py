"""OTLP trace requests, JSON and protobuf, as spans."""

from __future__ import annotations

import base64
import gzip
import json
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.schema import SPAN_SCHEMA

#: Fixed values of the format.
KIND_CODES = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS_CODES = {1: "ok", 2: "error"}
_MAP = "map<string,variant>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _last_wins(entries: Column) -> Column:
    """A map of entries; of entries with one key the last counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, values)


def _first(v: Column, names: Sequence[str], kind: str) -> Column:
    return F.coalesce(*(_get(v, n, kind) for n in names))


def _both(name: str) -> tuple[str, str]:
    """A member's name and its snake_case spelling."""
    return name, "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _object(v: Column, *names: str) -> Column:
    """The first member that is an object."""
    return F.coalesce(*(F.when(_get(v, n, _MAP).isNotNull(), _get(v, n, "variant")) for n in names))


def _list(v: Column, *names: str) -> Column:
    """The objects of a member that is an array; an object stands for a list of itself."""
    whole = F.coalesce(_first(v, names, "array<variant>"), F.array(_object(v, *names)), F.array().cast("array<variant>"))
    return F.filter(whole, lambda e: F.try_variant_get(e, "$", _MAP).isNotNull())


def attributes(owner: Column) -> Column:
    """attributes of a JSON object as a map. A value is the first of string, int,
    double and bool that is there, as it is written; any other value is its
    JSON text; an entry without key or value is _unknown = ''. attributes that are
    an object, but no entry, are taken as a map of plain values."""

    def one(a: Column) -> Column:
        key, value = _get(a, "key", "string"), _get(a, "value", "variant")
        scalars = [_get(a, f"value.{k}", "variant") for n in ("stringValue", "intValue", "doubleValue", "boolValue") for k in _both(n)]
        v = F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in scalars), F.to_json(value).cast("variant"))
        bad = key.isNull() | value.isNull() | F.is_variant_null(value)
        return F.named_struct(F.lit("k"), F.when(bad, "_unknown").otherwise(key), F.lit("v"), F.when(bad, F.lit("").cast("variant")).otherwise(v))

    m = _get(owner, "attributes", _MAP)
    entry = m["key"].isNotNull() & F.try_variant_get(m["value"], "$", _MAP).isNotNull()
    plain = F.transform_values(m, lambda _, v: F.when(F.try_variant_get(v, "$", _MAP).isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.to_json(v).cast("variant")).otherwise(v))
    return F.when(m.isNotNull() & ~F.coalesce(entry, F.lit(False)), plain).otherwise(_last_wins(F.transform(_list(owner, "attributes"), one)))


def _ns(v: Column, name: str) -> Column:
    """Nanoseconds written as number or text; only whole digits at the start count, else 0."""
    return F.coalesce(F.regexp_extract(_first(v, _both(name), "string"), r"^[+-]?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("long"))


def _code(v: Column, codes: dict[int, str], prefix: str, default: str) -> Column:
    out = F.lit(default)
    for k, name in codes.items():
        out = F.when((v == str(k)) | (F.upper(v) == prefix + name.upper()) | (F.lower(v) == name), name).otherwise(out)
    return F.when(v.isNull(), default).otherwise(out)


def decode_json(payloads: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Spans of OTLP JSON requests in canonical columns; keep: columns of payloads that
    come along. Members may be spelt in camelCase or snake_case, scopes by their older
    name, and an object may stand for a list of one. A body that is null or no JSON, or
    holds no resource spans, gives no rows."""
    b = payloads.select(*keep, F.try_parse_json(body).alias("_b"))
    b = b.select(*keep, F.explode(_list(F.col("_b"), *_both("resourceSpans"))).alias("_r"))
    b = b.select(*keep, attributes(_object(F.col("_r"), "resource")).alias("resource"), F.explode(_list(F.col("_r"), *_both("scopeSpans"), *_both("instrumentationLibrarySpans"))).alias("_s"))
    b = b.select(*keep, "resource", _object(F.col("_s"), "scope", *_both("instrumentationLibrary")).alias("_c"), F.explode(_list(F.col("_s"), "spans")).alias("_p"))
    p = F.col("_p")
    scope = F.when(F.col("_c").isNotNull(), F.struct(F.coalesce(_get(F.col("_c"), "name", "string"), F.lit("")).alias("name"), _get(F.col("_c"), "version", "string").alias("version")))

    def event(e: Column) -> Column:
        return F.named_struct(F.lit("name"), F.coalesce(_get(e, "name", "string"), F.lit("")), F.lit("timestamp"), _ns(e, "timeUnixNano"), F.lit("attributes"), attributes(e))

    start, end = _ns(p, "startTimeUnixNano"), _ns(p, "endTimeUnixNano")
    return b.select(
        *keep,
        F.coalesce(_first(p, _both("traceId"), "string"), F.lit("")).alias("trace_id"),
        F.coalesce(_first(p, _both("spanId"), "string"), F.lit("")).alias("span_id"),
        F.nullif(_first(p, _both("parentSpanId"), "string"), F.lit("")).alias("parent_span_id"),
        F.coalesce(_get(p, "name", "string"), F.lit("")).alias("name"),
        _code(_get(p, "kind", "string"), KIND_CODES, "SPAN_KIND_", "internal").alias("kind"),
        start.alias("start_time"),
        end.alias("end_time"),
        F.coalesce(F.try_subtract(end, start), F.lit(0).cast("long")).alias("duration_ns"),
        _code(_get(p, "status.code", "string"), STATUS_CODES, "STATUS_CODE_", "unset").alias("status"),
        _get(p, "status.message", "string").alias("status_message"),
        attributes(p).alias("attributes"),
        F.transform(_list(p, "events"), event).alias("events"),
        "resource",
        scope.alias("instrumentation_scope"),
    )


# --- protobuf --------------------------------------------------------------------


class DecodeError(ValueError):
    pass


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if i >= len(b) or shift > 63:
            raise DecodeError("cut off")
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        if x < 128:
            return n & (2**64 - 1), i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
            if i > len(b):
                raise DecodeError("cut off")
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            v, i = int.from_bytes(b[i : i + n], "little"), i + n
            if i > len(b):
                raise DecodeError("cut off")
        else:
            raise DecodeError(f"wire type {kind}")
        yield tag >> 3, kind, v


def _signed(n: int) -> int:
    return n - 2**64 if n >= 2**63 else n


def _any(b: bytes):
    out = None
    for no, kind, v in _fields(b):
        if no == 1 and kind == 2:
            out = v.decode("utf-8", "replace")
        elif no == 2:
            out = bool(v)
        elif no == 3:
            out = _signed(v)
        elif no == 4:
            out = struct.unpack("<d", v.to_bytes(8, "little"))[0]
        elif no == 5:
            out = [_any(x) for n, _, x in _fields(v) if n == 1]
        elif no == 6:
            out = dict(_pair(x) for n, _, x in _fields(v) if n == 1)
        elif no == 7:
            out = base64.b64encode(v).decode()
    return out


def _pair(b: bytes) -> tuple[str, object]:
    key, value = "", None
    for no, _, v in _fields(b):
        if no == 1:
            key = v.decode("utf-8", "replace")
        elif no == 2:
            value = _any(v)
    return key, value


def _scalar(v):
    """Strings, numbers and truth values stay; anything else is its text."""
    return v if isinstance(v, (str, int, float, bool)) else json.dumps(v)


def _pairs(items: list[bytes]) -> dict:
    return {k: _scalar(v) for k, v in map(_pair, items)}


def _many(b: bytes) -> dict[int, list]:
    got: dict[int, list] = {}
    for no, _, v in _fields(b):
        got.setdefault(no, []).append(v)
    return got


def _text(m: dict[int, list], no: int) -> str:
    return m[no][-1].decode("utf-8", "replace") if no in m else ""


def parse_protobuf(body: bytes) -> list[dict]:
    """Spans of a request, with maps as JSON text; body may be gzipped."""
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    out = []
    for rs in _many(body).get(1, []):
        r = _many(rs)
        resource = _pairs(_many(r[1][-1]).get(1, [])) if 1 in r else {}
        for ss in r.get(2, []):
            s = _many(ss)
            scope = _many(s[1][-1]) if 1 in s else None
            for raw in s.get(2, []):
                p = _many(raw)
                start, end = (_signed(p[n][-1]) if n in p else 0 for n in (7, 8))
                st = _many(p[15][-1]) if 15 in p else {}
                events = []
                for e in p.get(11, []):
                    m = _many(e)
                    events.append({"name": _text(m, 2), "timestamp": _signed(m[1][-1]) if 1 in m else 0, "attributes": _pairs(m.get(3, []))})
                out.append(
                    {
                        "trace_id": p[1][-1].hex() if 1 in p else "",
                        "span_id": p[2][-1].hex() if 2 in p else "",
                        "parent_span_id": (p[4][-1].hex() or None) if 4 in p else None,
                        "name": _text(p, 5),
                        "kind": KIND_CODES.get(p[6][-1] if 6 in p else 0, "internal"),
                        "start_time": start,
                        "end_time": end,
                        "duration_ns": end - start,
                        "status": STATUS_CODES.get(st[3][-1] if 3 in st else 0, "unset"),
                        "status_message": _text(st, 2) or None,
                        "attributes": json.dumps(_pairs(p.get(9, []))),
                        "events": json.dumps(events),
                        "resource": json.dumps(resource),
                        "scope": json.dumps({"name": _text(scope, 1), "version": _text(scope, 2) or None}) if scope is not None else None,
                    }
                )
    return out


FLAT = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time bigint, end_time bigint, duration_ns bigint, status string, status_message string, attributes string, events string, resource string, scope string"


def variant_fields(flat: DataFrame) -> DataFrame:
    """Canonical spans from rows whose nested columns are JSON text."""
    kinds = dict(x.strip().split(" ", 1) for x in SPAN_SCHEMA.replace(", ", "\n").split("\n"))

    def as_(c: str, kind: str) -> Column:
        return F.variant_get(F.parse_json(c), "$", kind)

    event = F.transform(
        as_("events", "array<variant>"),
        lambda e: F.named_struct(F.lit("name"), F.variant_get(e, "$.name", "string"), F.lit("timestamp"), F.variant_get(e, "$.timestamp", "bigint"), F.lit("attributes"), F.variant_get(e, "$.attributes", _MAP)),
    )
    plain = [c for c in kinds if c not in ("attributes", "events", "resource", "instrumentation_scope")]
    return flat.select(*plain, as_("attributes", _MAP).alias("attributes"), event.alias("events"), as_("resource", _MAP).alias("resource"), F.from_json("scope", kinds["instrumentation_scope"]).alias("instrumentation_scope"))


def decode_protobuf(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Spans of binary OTLP requests; a body that can't be decoded gives no rows.
    The wire format is read in Python, as the built-in reader needs a package
    that may be missing."""
    names = [x.split()[0] for x in FLAT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for v in b.column(0).to_pylist():
                try:
                    rows += parse_protobuf(v) if v is not None else []
                except (DecodeError, OSError, EOFError, struct.error, AttributeError, TypeError):
                    continue
            for k in range(0, len(rows), 10_000):
                some = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], pa.int64() if n.endswith(("_time", "_ns")) else pa.string()) for n in names], names)

    return variant_fields(payloads.select(body).mapInArrow(run, FLAT))
