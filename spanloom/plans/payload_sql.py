"""SQL of the tables of OTLP payloads: the JSON is taken apart level by level, attribute values by recursion."""

from __future__ import annotations


def _get(x: str, *names: str) -> str:
    return "coalesce(" + ", ".join(f"{x}->'$.{n}'" for n in names) + ")" if len(names) > 1 else f"{x}->'$.{names[0]}'"


def _list(x: str) -> str:
    return f"case json_type({x}) when 'ARRAY' then cast({x} as json[]) when 'OBJECT' then [{x}] else cast([] as json[]) end"


def _level(name: str, source: str, keep: str, x: str, no: str) -> str:
    return f"""{name} as (select * from (select {keep}, unnest(l) x, cast(unnest(range(len(l))) as bigint) {no} from (select {keep}, {_list(x)} l from {source})) where json_type(x) = 'OBJECT')"""


_LEVELS = ",\n".join(
    [
        "j as (select payload_id, cast(body as json) x from otlp_payloads where body is not null and json_valid(body) and payload_id is not null)",
        _level("rs", "j", "payload_id", _get("x", "resourceSpans", "resource_spans"), "rs_no"),
        _level("ss", "rs", "payload_id, rs_no", _get("x", "scopeSpans", "scope_spans", "instrumentationLibrarySpans", "instrumentation_library_spans"), "ss_no"),
        _level("sp", "ss", "payload_id, rs_no, ss_no", "x->'$.spans'", "span_no"),
        _level("ev", "sp", "payload_id, rs_no, ss_no, span_no", "x->'$.events'", "event_no"),
        "re as (select payload_id, rs_no, x->'$.resource' x from rs where json_type(x->'$.resource') = 'OBJECT')",
        f"sc as (select * from (select payload_id, rs_no, ss_no, {_get('x', 'scope', 'instrumentationLibrary', 'instrumentation_library')} x from ss) where json_type(x) = 'OBJECT')",
    ]
)
_KIDS = f"""case when typed and json_type(v) = 'OBJECT' then list_concat(
    [{{'p': path || '/' || (e->>'$.key'), 'v': e->'$.value', 't': true}} for e in {_list("coalesce(v->'$.kvlistValue'->'$.values', v->'$.kvlist_value'->'$.values')")} if json_type(e->'$.key') = 'VARCHAR' and json_type(e->'$.value') <> 'NULL'],
    list_transform(range(len(a)), lambda i: {{'p': path || '/' || i, 'v': a[i + 1], 't': true}}))
  when json_type(v) = 'OBJECT' then [{{'p': path || '/' || k, 'v': json_extract(v, '$."' || k || '"'), 't': false}} for k in json_keys(v)]
  when json_type(v) = 'ARRAY' then list_transform(range(len(cast(v as json[]))), lambda i: {{'p': path || '/' || i, 'v': (cast(v as json[]))[i + 1], 't': false}})
  else [] end"""
_ARR = _list("coalesce(v->'$.arrayValue'->'$.values', v->'$.array_value'->'$.values')")
_NUMS = "payload_id, owner, rs_no, ss_no, span_no, event_no"
_SCALAR = " or ".join(f"json_type(v->'$.{n}') not in ('NULL', 'OBJECT', 'ARRAY')" for s in ("string", "int", "double", "bool", "bytes") for n in (f"{s}Value", f"{s}_value"))
_WALK = f"""with recursive {_LEVELS},
o as (select payload_id, 'resource' as owner, rs_no, -1::bigint ss_no, -1::bigint span_no, -1::bigint event_no, x->'$.attributes' a from re
  union all select payload_id, 'scope', rs_no, ss_no, -1, -1, x->'$.attributes' from sc
  union all select payload_id, 'span', rs_no, ss_no, span_no, -1, x->'$.attributes' from sp
  union all select payload_id, 'event', rs_no, ss_no, span_no, event_no, x->'$.attributes' from ev),
n({_NUMS}, path, v, typed) as (
  select {_NUMS}, e->>'$.key', e->'$.value', true from (select {_NUMS}, unnest(cast(a as json[])) e from o where json_type(a) = 'ARRAY') where json_type(e->'$.key') = 'VARCHAR' and json_type(e->'$.value') <> 'NULL'
  union all select {_NUMS}, k, json_extract(a, '$."' || k || '"'), false from (select {_NUMS}, a, unnest(json_keys(a)) k from o where json_type(a) = 'OBJECT')
  union all select {_NUMS}, u.p, u.v, u.t from (select {_NUMS}, unnest({_KIDS}) u from (select *, {_ARR} a from n)))"""
P2_FOUND = f"""{_WALK}
select distinct {_NUMS}, path attr_path from n
where case when typed and json_type(v) = 'OBJECT' then {_SCALAR} else json_type(v) not in ('NULL', 'OBJECT', 'ARRAY') end"""

_TYPED = ", ".join(f"""{{'k': '{s}', 'v': coalesce({", ".join(f"case when json_type(v->'$.{n}') not in ('NULL', 'OBJECT', 'ARRAY') then v->>'$.{n}' end" for n in (f"{s}Value", f"{s}_value"))})}}""" for s in ("string", "int", "double", "bool", "bytes"))
P2_VALUES = f"""{_WALK}
select {_NUMS}, path attr_path, u.v attr_value, u.k attr_type from (select {_NUMS}, path, unnest([{_TYPED}]) u from n where typed and json_type(v) = 'OBJECT') where u.v is not null
union all select {_NUMS}, path, v->>'$', case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'DOUBLE' then 'double' else 'int' end
from n where not (typed and json_type(v) = 'OBJECT') and json_type(v) not in ('NULL', 'OBJECT', 'ARRAY')"""


def _text(*names: str) -> str:
    one = [f"case when json_type(x->'$.{n}') not in ('NULL', 'OBJECT', 'ARRAY') then x->>'$.{n}' end" for n in names]
    return f"coalesce({', '.join(one)})" if len(one) > 1 else one[0]


P2_SPANS = f"""with {_LEVELS} select payload_id, rs_no, ss_no, span_no, -1::bigint event_no, {_text("traceId", "trace_id")} trace_id, {_text("spanId", "span_id")} span_id,
  {_text("parentSpanId", "parent_span_id")} parent_span_id, {_text("name")} as name, {_text("kind")} kind, {_text("startTimeUnixNano", "start_time_unix_nano")} start_time_unix_nano,
  {_text("endTimeUnixNano", "end_time_unix_nano")} end_time_unix_nano, {_text("status.code")} status_code, {_text("status.message")} status_message from sp"""
P2_RESOURCES = f"with {_LEVELS} select payload_id, rs_no, -1::bigint ss_no, -1::bigint span_no, -1::bigint event_no from re"
P2_SCOPES = f"with {_LEVELS} select payload_id, rs_no, ss_no, -1::bigint span_no, -1::bigint event_no, {_text('name')} as name, {_text('version')} as version from sc"
P2_EVENTS = f"with {_LEVELS} select payload_id, rs_no, ss_no, span_no, event_no, {_text('name')} as name, {_text('timeUnixNano', 'time_unix_nano')} time_unix_nano from ev"

SQL = {
    "p2_found": P2_FOUND,
    "p2_payload_values": P2_VALUES,
    "p2_payload_spans": P2_SPANS,
    "p2_payload_resources": P2_RESOURCES,
    "p2_payload_scopes": P2_SCOPES,
    "p2_payload_events": P2_EVENTS,
}


def _digits(*names: str) -> str:
    return f"coalesce(try_cast(regexp_extract({_text(*names)}, '^[+-]?[0-9]+') as bigint), 0)"


_NAMED = f"""sn as (select *, coalesce({_text("traceId", "trace_id")}, '') trace_id, coalesce({_text("spanId", "span_id")}, '') span_id, coalesce({_text("name")}, '') as name, {_text("kind")} k, {_text("status.code")} c from sp)"""
_ENTRY_VALUE = "coalesce(" + ", ".join(f"case when json_type(e->'$.value') = 'OBJECT' then e->>'$.value.{n}' end" for s in ("string", "int", "double", "bool") for n in (f"{s}Value", f"{s}_value")) + ", cast(e->'$.value' as varchar))"


def _attributes(owner: str, a: str, source: str) -> str:
    """The entries of attributes of each span, of entries with one key the last."""
    bad = "json_type(e->'$.key') is null or json_type(e->'$.key') = 'NULL' or json_type(e->'$.value') is null or json_type(e->'$.value') = 'NULL'"
    who = "payload_id, rs_no, ss_no, span_no, trace_id, span_id, name"
    return f"""select {who}, '{owner}' as owner, k as key, arg_max(v, i) as value from (
  select {who}, i, case when {bad} then '_unknown' else e->>'$.key' end k, case when {bad} then '' else {_ENTRY_VALUE} end v from (select {who}, unnest(l) e, unnest(range(len(l))) i from (select {who}, {_list(a)} l from {source} where json_type({a}) = 'ARRAY' or json_type({a}->'$.value') = 'OBJECT')) where json_type(e) = 'OBJECT'
  union all select {who}, 0, k, {a}->>('$."' || k || '"') from (select {who}, {a}, unnest(json_keys({a})) k from {source} where json_type({a}) = 'OBJECT' and coalesce(json_type({a}->'$.value'), '') <> 'OBJECT')) group by all"""


SQL["otlp_decode"] = f"""with {_LEVELS}, {_NAMED}, n as (select payload_id, rs_no, ss_no, span_no, count(*) n_events from ev group by all)
select payload_id, trace_id, span_id, nullif({_text("parentSpanId", "parent_span_id")}, '') parent_span_id, name,
  case when k in ('2', 'SPAN_KIND_SERVER') then 'server' when k in ('3', 'SPAN_KIND_CLIENT') then 'client' when k in ('4', 'SPAN_KIND_PRODUCER') then 'producer' when k in ('5', 'SPAN_KIND_CONSUMER') then 'consumer' else 'internal' end kind,
  {_digits("startTimeUnixNano", "start_time_unix_nano")} start_time, {_digits("endTimeUnixNano", "end_time_unix_nano")} end_time,
  {_digits("endTimeUnixNano", "end_time_unix_nano")} - {_digits("startTimeUnixNano", "start_time_unix_nano")} duration_ns,
  case when c in ('1', 'STATUS_CODE_OK') then 'ok' when c in ('2', 'STATUS_CODE_ERROR') then 'error' else 'unset' end status, {_text("status.message")} status_message,
  case when s.payload_id is not null then coalesce(s.name_, '') end scope_name, version_ scope_version, coalesce(n_events, 0) n_events
from sn left join (select payload_id, rs_no, ss_no, {_text("name")} name_, {_text("version")} version_ from sc) s using (payload_id, rs_no, ss_no) left join n using (payload_id, rs_no, ss_no, span_no)"""
SQL["otlp_attributes"] = f"""with {_LEVELS}, {_NAMED}, a as (select *, x->'$.attributes' a from sn), r as (select sn.* exclude (x), re.x->'$.attributes' a from sn join re using (payload_id, rs_no)),
u as ({_attributes("span", "a", "a")} union all {_attributes("resource", "a", "r")}) select payload_id, trace_id, span_id, name, owner, key, try_cast(value as double) number, case when try_cast(value as double) is null and not starts_with(value, '{{') then value end as value, starts_with(value, '{{') is_json from u"""
SQL["otlp_events"] = f"""with {_LEVELS}, {_NAMED}, e as (select *, row_number() over (partition by payload_id, rs_no, ss_no, span_no order by event_no) - 1 place from ev)
select payload_id, trace_id, span_id, name, place event_no, coalesce(event_name, '') event_name, event_ts, n_attributes from (
  select payload_id, rs_no, ss_no, span_no, place, {_text("name")} event_name, {_digits("timeUnixNano", "time_unix_nano")} event_ts,
    case when json_type(x->'$.attributes') = 'OBJECT' and coalesce(json_type(x->'$.attributes.value'), '') <> 'OBJECT' then len(json_keys(x->'$.attributes')) else (select count(distinct case when json_type(a->'$.key') is null or json_type(a->'$.key') = 'NULL' or json_type(a->'$.value') is null or json_type(a->'$.value') = 'NULL' then '_unknown' else a->>'$.key' end) from (select unnest({_list("x->'$.attributes'")}) a) where json_type(a) = 'OBJECT') end n_attributes from e) join sn using (payload_id, rs_no, ss_no, span_no)"""
