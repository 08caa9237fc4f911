"""Queries of the general data operators (p1, p2, p3, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import hierarchy, intervals, nested, orphans
from spanloom.plans import payload_sql
from spanloom.runtime import table
from spanloom.streaming import dedup


def _store(spark, d):
    return (table(spark, d, x) for x in ("spans", "trace_index", "blocks", "block_files"))


def _part(spark, d):
    """A fiftieth of the spans: the largest trace holds several times as many."""
    return max(50, table(spark, d, "spans").count() // 50)


def _ranges(spark, d, **k):
    """Each span's place in its trace and the places of its descendants."""
    got = hierarchy.span_hierarchy(table(spark, d, "spans"), ranges=True, **k)
    return got.select("trace_id", "span_id", "n_descendants", *hierarchy.RANGES)


QUERIES = {
    "p1_found": lambda s, d: orphans.store_orphans(*_store(s, d)),
    "p1_orphan_counts": lambda s, d: orphans.store_orphan_counts(*_store(s, d)),
    "p2_found": lambda s, d: nested.payload_attribute_paths(table(s, d, "otlp_payloads")),
    "p2_payload_spans": lambda s, d: nested.payload_table(table(s, d, "otlp_payloads"), "spans"),
    "p2_payload_resources": lambda s, d: nested.payload_table(table(s, d, "otlp_payloads"), "resources"),
    "p2_payload_scopes": lambda s, d: nested.payload_table(table(s, d, "otlp_payloads"), "scopes"),
    "p2_payload_events": lambda s, d: nested.payload_table(table(s, d, "otlp_payloads"), "events"),
    "p2_payload_values": lambda s, d: nested.payload_table(table(s, d, "otlp_payloads"), "attributes"),
    "p2_span_attributes": lambda s, d: nested.span_attributes(table(s, d, "spans")),
    "p2_span_events": lambda s, d: nested.span_events(table(s, d, "spans")),
    "p2_event_attributes": lambda s, d: nested.event_attributes(table(s, d, "spans")),
    "p2_span_values": lambda s, d: nested.span_values(table(s, d, "spans")),
    "p2_span_scopes": lambda s, d: nested.span_scopes(table(s, d, "spans")),
    "p2_span_scope_links": lambda s, d: nested.span_scope_links(table(s, d, "spans")),
    "p2_span_core": lambda s, d: nested.span_core(table(s, d, "spans")),
    "p3_found": lambda s, d: hierarchy.span_hierarchy(table(s, d, "spans")),
    "p3_paths": lambda s, d: hierarchy.span_hierarchy(table(s, d, "spans"), path=True).withColumn("path", F.concat_ws("/", "path")),
    "p3_descendants": lambda s, d: _ranges(s, d),
    # the way of groups that no task may hold whole, compared with the same SQL
    "p3_blocks_found": lambda s, d: hierarchy.span_hierarchy(table(s, d, "spans"), group_rows=_part(s, d)),
    "p3_blocks_paths": lambda s, d: hierarchy.span_hierarchy(table(s, d, "spans"), path=True, group_rows=_part(s, d)).withColumn("path", F.concat_ws("/", "path")),
    "p3_blocks_descendants": lambda s, d: _ranges(s, d, group_rows=_part(s, d)),
    "p5_found": lambda s, d: dedup.span_copies(s, f"{d}/spans.parquet"),
    "p5_kept": lambda s, d: dedup.span_kept(s, f"{d}/spans.parquet").select("recv_no", "trace_id", "span_id", "name"),
    "p5_batches": lambda s, d: dedup.stream_totals(s, f"{d}/spans.parquet"),
    "p6_found": lambda s, d: intervals.trace_gaps(table(s, d, "spans")),
    "p6_periods": lambda s, d: intervals.trace_periods(table(s, d, "spans")),
    "p6_sliced_gaps": lambda s, d: intervals.trace_gaps(table(s, d, "spans"), _part(s, d)),
    "p6_sliced_periods": lambda s, d: intervals.trace_periods(table(s, d, "spans"), _part(s, d)),
}

_ID = "nullif(lower(trim({0}, chr(32)||chr(9)||chr(10)||chr(13))), '')"


def _id(c: str) -> str:
    return _ID.format(c)


_T, _S, _P = _id("trace_id"), _id("span_id"), _id("parent_span_id")
_SPANS = f"""n as (select {_T} t, {_S} s, arg_min(case when replace({_P}, '0', '') <> '' then {_P} else '' end, recv_no) p, arg_min(start_time, recv_no) st
  from spans where {_T} is not null and {_S} is not null group by 1, 2)"""
_DAY = "strftime(make_timestamp({0} // 1000), '%Y-%m-%d')"
_FILE = "regexp_replace(regexp_replace(regexp_replace({0}, '/{{2,}}', '/', 'g'), '^(\\./)*/srv/spanstore/', ''), '^(\\./)+', '')"
_ORPHANS = f"""with {_SPANS},
a as (select 'spans' ref_table, n.t || ':' || n.s ref_key, n.p missing_key, {_DAY.format("n.st")} period
  from n left join n m on m.t = n.t and m.s = n.p where n.p <> '' and m.s is null),
i as (select {_T} t, block_id, min(indexed_at) seen_at from trace_index where block_id is not null and {_T} is not null group by 1, 2),
b as (select 'trace_index', i.t, cast(i.block_id as varchar), strftime(i.seen_at, '%Y-%m-%d') from i
  where not exists (select 1 from blocks x where x.block_id = i.block_id and x.deleted_at is null)),
c as (select 'blocks', cast(block_id as varchar), file_path, strftime(min(created_at), '%Y-%m-%d') from blocks
  where deleted_at is null and file_path is not null and block_id is not null
  and {_FILE.format("file_path")} not in (select {_FILE.format("file_path")} from block_files where removed_at is null and file_path is not null)
  group by block_id, file_path),
o as (select * from a union all select * from b union all select * from c)"""
_TREE = f"""with recursive {_SPANS},
e as (select n.t, n.s, n.st, m.s p from n left join n m on m.t = n.t and m.s = n.p),
up(t, s, a, k, seen) as (
  select t, s, s, 0, [s] from e
  union all
  select up.t, up.s, e.p, up.k + 1, list_append(up.seen, e.p) from up join e on e.t = up.t and e.s = up.a
  where e.p is not null and not list_contains(up.seen, e.p)),
top as (select t, s, max(k) k, arg_max(a, k) root, arg_max(seen, k) seen from up group by t, s),
fin as (select top.*, e.p back from top join e on e.t = top.t and e.s = top.root),
sub as (select t, a s, count(*) - 1 n from up group by 1, 2),
tree as (select fin.t trace_id, fin.s span_id, case when back is null then root else '' end root_span_id,
  cast(case when back is null then k when back = fin.s then -1 else -2 end as bigint) depth, cast(sub.n as bigint) n_descendants,
  case when back is null then list_reverse(seen) else [] end path, fin.root, fin.seen
  from fin join sub on sub.t = fin.t and sub.s = fin.s)"""
_ISLANDS = f"""with v as (select {_T} t, start_time s, max(end_time) e from spans where {_T} is not null and end_time >= start_time group by 1, 2),
w as (select *, max(e) over (partition by t order by s rows between unbounded preceding and 1 preceding) seen from v),
x as (select *, case when seen is null or s > seen then 1 else 0 end fresh from w),
y as (select *, sum(fresh) over (partition by t order by s rows unbounded preceding) no from x)"""
_VALUE_KIDS = """case json_type(v) when 'OBJECT' then list_transform(json_keys(v), lambda k: {'p': k, 'v': json_extract(v, '$."' || k || '"')})
  when 'ARRAY' then list_transform(range(len(cast(v as json[]))), lambda i: {'p': cast(i as varchar), 'v': cast(v as json[])[i + 1]}) else [] end"""
_VALUES = f"""with recursive e as (select recv_no, {_T} trace_id, {_S} span_id, unnest(events) e, unnest(range(len(events))) event_no from spans),
u as (select recv_no, {_T} trace_id, {_S} span_id, 'span' as owner, -1::bigint event_no, unnest(map_entries(attributes)) a from spans
  union all select recv_no, {_T}, {_S}, 'resource', -1, unnest(map_entries(resource)) from spans
  union all select recv_no, trace_id, span_id, 'event', cast(event_no as bigint), unnest(map_entries(e.attributes)) from e),
j as (select * exclude (a), a.key attr_key, a.value x, case when regexp_matches(a.value, '^[ \\t\\r\\n]*[\\[{{]') and json_valid(a.value) then cast(a.value as json) end v from u),
n as (select * exclude (x), attr_key attr_path from j where v is not null
  union all select * exclude (k, v, attr_path), k.v, attr_path || '/' || k.p from (select *, unnest({_VALUE_KIDS}) k from n))
select * exclude (x, v), attr_key attr_path, x attr_value, case when x is not null then 'string' end attr_type from j where v is null
union all select * exclude (v), case when json_type(v) <> 'NULL' then v->>'$' end,
  case json_type(v) when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'DOUBLE' then 'double' when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'NULL' then null else 'int' end
  from n where len({_VALUE_KIDS}) = 0"""

SQL = {
    **payload_sql.SQL,
    "p1_found": f"{_ORPHANS} select * from o",
    "p1_orphan_counts": f"{_ORPHANS} select ref_table, period, cast(count(*) as bigint) n_orphans, cast(count(distinct case ref_table when 'spans' then split_part(ref_key, ':', 1) || ':' || missing_key when 'blocks' then {_FILE.format('missing_key')} else missing_key end) as bigint) n_missing_keys from o group by 1, 2",
    "p2_span_attributes": f"""with u as (select recv_no, {_T} trace_id, {_S} span_id, 'span' as owner, unnest(map_entries(attributes)) e from spans
  union all select recv_no, {_T}, {_S}, 'resource', unnest(map_entries(resource)) from spans)
select recv_no, trace_id, span_id, owner, e.key attr_key, e.value attr_value from u""",
    "p2_span_events": f"""with u as (select recv_no, {_T} trace_id, {_S} span_id, unnest(events) e, unnest(range(len(events))) event_no from spans)
select recv_no, trace_id, span_id, cast(event_no as bigint) event_no, e.name event_name, e.ts event_ts from u""",
    "p2_event_attributes": f"""with u as (select recv_no, {_T} trace_id, {_S} span_id, unnest(events) e, unnest(range(len(events))) event_no from spans),
v as (select recv_no, trace_id, span_id, cast(event_no as bigint) event_no, unnest(map_entries(e.attributes)) a from u)
select recv_no, trace_id, span_id, event_no, a.key attr_key, a.value attr_value from v""",
    "p2_span_values": _VALUES,
    "p2_span_scopes": "select instrumentation_scope.name scope_name, instrumentation_scope.version scope_version, cast(count(*) as bigint) n_receipts from spans where instrumentation_scope is not null group by 1, 2",
    "p2_span_scope_links": f"select recv_no, {_T} trace_id, {_S} span_id, instrumentation_scope.name scope_name, instrumentation_scope.version scope_version from spans where instrumentation_scope is not null",
    "p2_span_core": f"select recv_no, {_T} trace_id, {_S} span_id, case when replace({_P}, '0', '') <> '' then {_P} end parent_id, name, start_time, end_time from spans",
    "p3_found": f"{_TREE} select trace_id, span_id, root_span_id, depth, n_descendants from tree",
    "p3_paths": f"{_TREE} select trace_id, span_id, root_span_id, depth, n_descendants, array_to_string(path, '/') path from tree",
    "p3_descendants": f"""{_TREE},
ring as (select trace_id, span_id, list_min(seen) circle, seen from tree where depth = -1),
keyed as (select t.*, coalesce(r.circle, '') circle, case when t.depth >= 0 then t.path when t.depth = -1 then [t.span_id] else list_reverse(list_filter(t.seen, lambda x: not list_contains(r.seen, x))) end k
  from tree t left join ring r on t.depth < 0 and r.trace_id = t.trace_id and r.span_id = t.root),
placed as (select *, row_number() over (partition by trace_id order by depth < 0, circle, depth = -2, k) - 1 pos from keyed),
opened as (select *, case when depth = -1 then min(pos) over (partition by trace_id, circle) else pos + 1 end first_pos from placed)
select trace_id, span_id, n_descendants, pos, first_pos, case when depth = -1 then first_pos else pos end + n_descendants last_pos from opened""",
    "p5_found": f"""with r as (select recv_no, min(recv_no) over (partition by {_T}, {_S}) f from spans where {_T} is not null and {_S} is not null)
select f first_recv_no, recv_no copy_recv_no from r where recv_no > f""",
    "p5_kept": f"""with r as (select *, min(recv_no) over (partition by {_T}, {_S}) f from spans where {_T} is not null and {_S} is not null)
select recv_no, trace_id, span_id, name from r where recv_no = f""",
    "p5_batches": f"""select count(*) n_messages, count(distinct ({_T}, {_S})) n_new, count(*) - count(distinct ({_T}, {_S})) n_copies, true several_batches, true some_late
from spans where {_T} is not null and {_S} is not null""",
    "p6_found": f"{_ISLANDS} select t trace_id, seen gap_start, s gap_end from x where s > seen",
    "p6_periods": f"{_ISLANDS} select t trace_id, min(s) period_start, max(e) period_end, cast(count(*) as bigint) n_starts from y group by t, no",
}
SQL |= {f"p3_blocks_{x}": SQL[f"p3_{x}"] for x in ("found", "paths", "descendants")}
SQL |= {"p6_sliced_gaps": SQL["p6_found"], "p6_sliced_periods": SQL["p6_periods"]}
