"""The span record: canonical columns, defaults and promoted attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.enums import norm_kind, norm_status

SPAN_SCHEMA = (
    "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time bigint, end_time bigint, duration_ns bigint, "
    "status string, status_message string, attributes map<string,variant>, events array<struct<name:string,timestamp:bigint,attributes:map<string,variant>>>, "
    "resource map<string,variant>, instrumentation_scope struct<name:string,version:string>"
)
COLUMNS = ["trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "duration_ns", "status", "status_message", "attributes", "events", "resource", "instrumentation_scope"]

#: Attribute keys that are kept as columns of their own, so that
#: filters on them reach the Parquet scan. Those of TERM_ATTRIBUTES are terms of
#: the index when they stand in attributes, those of TERM_BOTH also in resource.
TERM_ATTRIBUTES = ["http.method", "http.status_code", "http.route", "db.system", "rpc.system", "messaging.system"]
TERM_BOTH = ["host", "host.name"]
PROMOTED = {"service.name": "service_name", **{k: "p_" + k.replace(".", "_") for k in TERM_BOTH + TERM_ATTRIBUTES}}

#: The resource's own value of the keys that are terms in both places.
RESOURCE_TERMS = {k: "r_" + k.replace(".", "_") for k in TERM_BOTH}

#: The name and all attribute values that are strings, in lower case, between
#: zero characters: what the name condition looks through.
SEARCH_TEXT = "search_text"

#: Ties of start_time are broken by these, so that pages are the same each time.
TIES = ["trace_id", "span_id", "duration_ns", "name", "kind", "status", "service_name"]


def text(v: Column) -> Column:
    """A variant as text."""
    return v.cast("string")


def lookup(key: str) -> Column:
    """An attribute's text: from attributes, else from resource."""
    return F.coalesce(text(F.col("attributes")[key]), text(F.col("resource")[key]))


def string_values(m: Column) -> Column:
    """The values of a map that are strings."""
    return F.transform(F.filter(F.map_values(m), lambda v: F.schema_of_variant(v) == "STRING"), text)


def promote(spans: DataFrame) -> DataFrame:
    """Adds the promoted columns and the text that names are looked up in."""
    found = F.lower(F.concat_ws("\0", F.array("name"), string_values(F.col("attributes"))))
    return spans.withColumns({**{c: lookup(k) for k, c in PROMOTED.items()}, **{c: text(F.col("resource")[k]) for k, c in RESOURCE_TERMS.items()}, SEARCH_TEXT: found})


def variant_map(**values: Column) -> Column:
    """A map of the values that aren't null; a key's dots are written __."""
    pairs = {k.replace("__", "."): v.cast("variant") for k, v in values.items()}

    def made(keys: list[str]) -> Column:
        return F.create_map(*(x for k in keys for x in (F.lit(k), pairs[k]))).cast("map<string,variant>")

    if len(pairs) > 2:
        return F.map_filter(made(list(pairs)), lambda _, v: v.isNotNull())
    out = made([])  # few values: by cases, without a call per entry
    for keys in [[k] for k in pairs] + [list(pairs)] * (len(pairs) == 2):
        there = F.lit(True)
        for k in keys:
            there = there & pairs[k].isNotNull()
        out = F.when(there, made(keys)).otherwise(out)
    return out


def from_raw(raw: DataFrame) -> DataFrame:
    """Canonical spans from rows that may lack columns or values: name '', kind
    internal, status unset, empty maps and list; a missing duration is end minus
    start, else 0; an empty parent is none. Other columns are left out."""
    have = dict(raw.dtypes)
    kinds = dict(x.strip().split(" ", 1) for x in SPAN_SCHEMA.replace(", ", "\n").split("\n"))

    def get(c: str) -> Column:
        if c not in have:
            return F.lit(None).cast(kinds[c])
        v = F.col(c)
        if kinds[c] == "map<string,variant>" and have[c] != kinds[c]:
            v = F.transform_values(v, lambda _, x: x.cast("variant"))
        return v

    empty = F.create_map().cast("map<string,variant>")
    return raw.select(
        get("trace_id").alias("trace_id"),
        get("span_id").alias("span_id"),
        F.nullif(get("parent_span_id"), F.lit("")).alias("parent_span_id"),
        F.coalesce(get("name"), F.lit("")).alias("name"),
        norm_kind(get("kind")).alias("kind"),
        get("start_time").alias("start_time"),
        get("end_time").alias("end_time"),
        F.coalesce(get("duration_ns"), get("end_time") - get("start_time"), F.lit(0).cast("long")).alias("duration_ns"),
        norm_status(get("status")).alias("status"),
        get("status_message").alias("status_message"),
        F.coalesce(get("attributes"), empty).alias("attributes"),
        F.coalesce(get("events"), F.array().cast(kinds["events"])).alias("events") if "events" not in have or have["events"] == kinds["events"] else get("events").alias("events"),
        F.coalesce(get("resource"), empty).alias("resource"),
        get("instrumentation_scope").alias("instrumentation_scope"),
    )
