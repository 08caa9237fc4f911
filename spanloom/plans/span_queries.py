"""Queries over the orders and events seen as spans, and their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from spanloom.config import EngineConfig
from spanloom.engine import Engine
from spanloom.functions import enums as E
from spanloom.functions import ids as I
from spanloom.operators import blocks as B
from spanloom.operators import jaeger as J
from spanloom.operators import search as S
from spanloom.operators.filters import where
from spanloom.plans import payload_sql
from spanloom.runtime import cut, table, work_path
from spanloom.sources import otlp
from spanloom.sources.fixtures import binary_requests, event_spans, order_spans
from spanloom.sources.schema import promote, text
from spanloom.sources.sdk import from_rest
from spanloom.sources.store import SpanStore
from spanloom.streaming.ingest import ingest, shard, tail

COLS = ["trace_id", "span_id", "parent_span_id", "name", "kind", "start_time", "end_time", "duration_ns", "status", "status_message"]
T1, T2 = 820_454_400_000_000_000, 883_612_799_000_000_000
LOW, HIGH = 1_000_000_000, 50_000_000_000
SOME_TRACE = "00000000000000000000000000000007"


def _cols(df):
    return df.select(*COLS, F.col("service_name").alias("service"))


def _filtered(**filters):
    return lambda s, d: _cols(where(order_spans(s, d), filters))


def _meta(**filters):
    return lambda s, d: S.page_meta(order_spans(s, d), filters)


def _page(**filters):
    return lambda s, d: _cols(S.page(order_spans(s, d), filters))


def _day_blocks(s, d):
    x = order_spans(s, d)
    return B.manifest(x, B.day_block()).withColumn("byte_size", F.col("entry_count") * 100)


def _blocks(s, d):
    return B.live_blocks(table(s, d, "blocks"))


def _span_tags(s, d):
    """All tags of all spans."""
    x = order_spans(s, d).unionByName(event_spans(s, d)).select("span_id", F.explode(J.span_tags()).alias("t")).select("span_id", "t.*")
    return x.select("span_id", "key", "type", text(F.col("value")).alias("value"))


def _logs(s, d):
    x = event_spans(s, d).select("span_id", F.explode(J.logs()).alias("l"))
    return x.select("span_id", F.col("l.timestamp").alias("ts_us"), F.explode("l.fields").alias("f")).select("span_id", "ts_us", F.col("f.key").alias("key"), text(F.col("f.value")).alias("value"))


def _ids(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    packed = I.pack_id(I.trace_hex("o_orderkey"))
    return o.select("o_orderkey", I.trace_hex("o_orderkey").alias("trace_hex"), I.span_hex("o_orderkey").alias("span_hex"), F.octet_length(packed).cast("long").alias("n_bytes"), I.binary_hex(packed).alias("round_trip"))


def _search_page(s, d):
    f = J.search_filters({"service": "furniture", "minDuration": "1s", "limit": "50"})
    return S.page(order_spans(s, d), f).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_spans"))


def _processes(s, d):
    return J.processes(order_spans(s, d))


def _process_tags(s, d):
    return J.process_tags(order_spans(s, d)).select("trace_id", "service", "key", "type", text(F.col("value")).alias("value"))


def _jaeger_spans(s, d):
    x = J.jaeger_spans(order_spans(s, d)).select("span.*")
    status = F.get(F.filter("tags", lambda t: t["key"] == "otel.status_code"), F.lit(0))["value"]
    return x.select("traceID", "spanID", "operationName", "startTime", "duration", "processID", F.size("references").cast("long").alias("n_refs"), F.get("references", F.lit(0))["spanID"].alias("parent"), text(status).alias("status"), F.size("tags").cast("long").alias("n_tags"))


def _jaeger_documents(s, d):
    """Every trace as a document, with its spans and processes taken out of the text again."""
    span = "traceID string, spanID string, operationName string, startTime long, duration long, processID string, references array<struct<spanID:string>>, tags array<struct<key:string,type:string,value:string>>"
    doc = F.from_json("json", f"traceID string, spans array<struct<{', '.join(x.replace(' ', ':', 1) for x in span.split(', '))}>>, processes map<string,struct<serviceName:string,tags:array<struct<key:string,value:string>>>>")
    x = J.jaeger_traces(order_spans(s, d)).select("trace_id", doc.alias("d")).select("trace_id", F.posexplode("d.spans").alias("at", "x"), "d.processes")
    p = F.col("processes")[F.col("x.processID")]
    tag = F.get(F.filter("x.tags", lambda t: t["key"] == "http.status_code"), F.lit(0))
    return x.select(
        "trace_id",
        F.col("at").cast("long").alias("place"),
        F.col("x.spanID").alias("span_id"),
        F.col("x.operationName").alias("name"),
        F.col("x.startTime").alias("start_us"),
        F.col("x.duration").alias("duration_us"),
        F.get("x.references", F.lit(0))["spanID"].alias("parent"),
        p["serviceName"].alias("service"),
        F.get(p["tags"], F.lit(0))["value"].alias("host"),
        F.size("x.tags").cast("long").alias("n_tags"),
        F.concat_ws(" ", tag["type"], tag["value"]).alias("code"),
    )


def _jaeger_json(s, d):
    """The text of every trace's document (one span in each: texts of several need SQL's
    own JSON writer to agree in every blank)."""
    x = where(event_spans(s, d), {}).withColumn("trace_id", F.col("span_id"))
    return J.jaeger_traces(x).select("trace_id", "json")


def _tail(s, d):
    """Error events from a stream over the events table, delivered to a listener."""
    path = f"{d}/events.parquet"
    exact = f"{path[:-1]}[{path[-1]}]"
    out = work_path(s, "tail")
    x = s.readStream.schema(s.read.parquet(path).schema).parquet(exact)
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "ok").otherwise("unset")
    x = x.select(F.col("event_id"), F.col("event_type").alias("name"), status.alias("status"), F.col("user_id"))
    q = tail(x, {"status": "error"}, lambda df, no: df.write.mode("overwrite").parquet(f"{out}/rows/batch={no}"), f"{out}/state")
    q.awaitTermination()
    return s.read.schema("event_id long, name string, status string, user_id long").parquet(f"{out}/rows/batch=*")


def _totals(spans):
    return spans.groupBy("status", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("total_ns"), F.min("start_time").alias("first"), F.max("start_time").alias("last"))


def _compaction(orders):
    """The same totals before and after a store's blocks are rewritten and merged:
    events and orders in large blocks, but for four slices of about 250 events each
    that become small blocks, which merge() must put together. Only a handful of events may leave slices empty."""

    def run(s, d):
        store = SpanStore(s, work_path(s, "store"))
        x = cut(event_spans(s, d), "events")
        piece = F.pmod(F.xxhash64("span_id"), F.lit(max(8, -(-x.count() // 250))))
        store.append(x.where(piece >= 4).repartition(4, "span_id"))
        store.compact(force=True)
        store.append(orders(order_spans(s, d)))
        store.compact(force=True)
        small = []
        for i in range(4):
            small.append(store.append(x.where(piece == i).coalesce(1)))
            store.compact(force=True)
        blocks, got = store.manifest().count(), store.merge()
        if all(small) and (got != "ok" or store.manifest().count() >= blocks):
            raise RuntimeError(f"merge: {got}, {blocks} blocks before")
        return _totals(store.spans())

    return run


def _decoded(s, d):
    return otlp.decode_json(table(s, d, "otlp_payloads"), keep=("payload_id",))


def _otlp(s, d):
    scope = F.col("instrumentation_scope")
    return _decoded(s, d).select("payload_id", *COLS, scope["name"].alias("scope_name"), scope["version"].alias("scope_version"), F.size("events").cast("long").alias("n_events"))


def _otlp_attributes(s, d):
    """attributes and resource of every decoded span as rows. Numbers are compared as such,
    JSON texts only counted, as a variant keeps neither trailing zeros nor the order of members."""
    x = _decoded(s, d)
    parts = [x.select("payload_id", "trace_id", "span_id", "name", F.lit(o).alias("owner"), F.explode(c).alias("key", "v")) for o, c in (("span", "attributes"), ("resource", "resource"))]
    return parts[0].unionByName(parts[1]).select("payload_id", "trace_id", "span_id", "name", "owner", "key", *_comparable(text(F.col("v"))))


def _comparable(v):
    number = v.try_cast("double")
    return number.alias("number"), F.when(number.isNull() & ~F.startswith(v, F.lit("{")), v).alias("value"), F.startswith(v, F.lit("{")).alias("is_json")


def _otlp_events(s, d):
    x = _decoded(s, d).select("payload_id", "trace_id", "span_id", "name", F.posexplode("events").alias("event_no", "e"))
    return x.select("payload_id", "trace_id", "span_id", "name", F.col("event_no").cast("long").alias("event_no"), F.col("e.name").alias("event_name"), F.col("e.timestamp").alias("event_ts"), F.size("e.attributes").cast("long").alias("n_attributes"))


def _shards(s, d):
    """Every shard is used, and a trace lies in one."""
    x = shard(order_spans(s, d), 4).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b"))
    return x.agg(F.sum("n").alias("n_spans"), F.count(F.lit(1)).alias("n_traces"), F.countDistinct("a").alias("n_shards"), F.min(F.col("a") == F.col("b")).alias("one_shard_each"))


def _store(s, d, pieces=3):
    """An engine over the orders as spans, in compressed and raw blocks."""
    e = Engine(s, work_path(s, "engine"), EngineConfig(retention_max_age_s=None))
    for i in range(pieces):
        if i == pieces - 1:
            e.store.compact(force=True)
        e.ingest(order_spans(s, d, (i, pieces)))  # by as many tasks as the tables have parts
    return e


def _store_trace(s, d):
    return _cols(_store(s, d).trace(SOME_TRACE))


def _store_search(s, d):
    f = {"service": "furniture", "status": "error", "since": T1}
    return _cols(where(_store(s, d)._spans(f), f))


def _store_page(s, d):
    """The newest page as the engine finds it, from the newest blocks alone."""
    e = _store(s, d)
    got = e.query({})
    rows = [(*(r[c] for c in COLS), r["service_name"], got.total) for r in got.entries]
    return s.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time long, end_time long, duration_ns long, status string, status_message string, service string, total long")


def _store_early_page(s, d):
    """A page without total: blocks are read from the newest until no other can change it."""
    got = _store(s, d).query({"status": "error", "limit": 40, "offset": 5, "count_total": False})
    return s.createDataFrame([(*(r[c] for c in COLS), r["service_name"], got.has_more) for r in got.entries], "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time long, end_time long, duration_ns long, status string, status_message string, service string, has_more boolean")


def _store_retention(s, d):
    """What is left after a cutoff has every span from then on, and no block of before."""
    store = _store(s, d).store
    store.delete_before(T1)
    store.vacuum(older_than_s=0)
    m = store.manifest().agg(F.coalesce(F.min("ts_max") >= T1, F.lit(True)).alias("no_older_block"))
    return store.spans().where(F.col("start_time") >= T1).agg(F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("total_ns")).crossJoin(m)  # one row each


def _memory(s, d):
    e = Engine(s, config=EngineConfig(storage="memory", retention_max_age_s=None))
    e.ingest(order_spans(s, d).coalesce(4))
    f = {"kind": "client", "attributes": {"db.system": "redis"}}
    got = _cols(where(e._spans(f), f))
    return got


def _block_spans(s, d):
    store = _store(s, d).store
    return _totals(store.block_spans(store.matching_block_ids()))


def _protobuf(s, d):
    return _cols(promote(otlp.decode_protobuf(binary_requests(order_spans(s, d)))))


def _stream_ingest(s, d):
    """Requests that arrive as a stream, in the store at its end."""
    path = f"{d}/otlp_payloads.parquet"
    exact = f"{path[:-1]}[{path[-1]}]"
    store = SpanStore(s, work_path(s, "streamed"))
    x = s.readStream.schema(s.read.parquet(path).schema).parquet(exact).select("body")
    ingest(x, store, work_path(s, "ingest")).awaitTermination()
    return store.spans().select(*COLS)


def _page_after(s, d):
    """The third page of 30 by the last row of the second, as the offset would give it."""
    x, f = order_spans(s, d), {"status": "error", "limit": 30}
    last = None
    for _ in range(2):
        last = (S.page(x, f) if last is None else S.page_after(x, f, last)).collect()[-1]
    return _cols(S.page_after(x, f, last))


def _search_range(s, d):
    f = J.search_filters({"service": "building", "operation": "order", "start": str(T1 // 1000), "end": str(T2 // 1000), "minDuration": "2000ms", "maxDuration": "900000000us", "limit": "70"})
    return _cols(S.page(order_spans(s, d), f))


def _store_concurrent(s, d):
    """Two writers and a compacting third on one store: nothing is lost or doubled."""
    root = work_path(s, "shared")
    x, y = order_spans(s, d), event_spans(s, d)
    half = F.pmod(F.xxhash64("trace_id"), F.lit(2))
    writers = [[x.where(half == 0), y.where(half == 1)], [x.where(half == 1), y.where(half == 0)]]

    def write(parts):
        store = SpanStore(s, root)
        return [store.append(p.coalesce(2)) for p in parts]

    def compact():
        store = SpanStore(s, root)
        return [store.compact(force=True) for _ in range(2)]

    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(compact), *(pool.submit(write, w) for w in writers)]
        for j in jobs:
            j.result()
    return _totals(SpanStore(s, root).spans())


def _store_backup(s, d):
    e = _store(s, d)
    to = work_path(s, "copy")
    e.backup(to)
    return _totals(SpanStore(s, to).spans())


def _store_counters(s, d):
    """Lifetime counters of compaction, against the list of blocks."""
    e = _store(s, d)
    e.store.compact(force=True)
    c = e.store.counters()
    m = e.store.manifest()
    return m.agg(F.sum("entry_count").alias("n_entries"), F.lit(c["compactions"]).cast("long").alias("compactions"), (F.sum("byte_size") == c["compressed_out"]).alias("sizes_agree"), F.lit(0 < c["compressed_out"] < c["raw_in"]).alias("smaller"))


def _rest(s, d):
    """Spans of the older layout, whose maps are one JSON text per row, read again."""
    x = order_spans(s, d)
    rest = F.to_json(F.struct("status_message", "attributes", "events", "resource"))
    old = x.select(*(c for c in COLS if c != "status_message"), rest.alias("rest"))
    return _cols(promote(from_rest(old)))


QUERIES = {
    "spans_all_count": lambda s, d: order_spans(s, d).agg(F.count(F.lit(1)).alias("n")),
    "filter_status_error": _filtered(status="error"),
    "filter_kind_server": _filtered(kind="server"),
    "filter_service": _filtered(service="furniture"),
    "filter_name_ci": _filtered(name="URGENT"),
    "filter_name_attribute": _filtered(name="sql"),
    "filter_duration_range": _filtered(min_duration=LOW, max_duration=HIGH),
    "filter_time_range": _filtered(since=T1, until=T2),
    "filter_trace_id": _filtered(trace_id=SOME_TRACE),
    "filter_attr_string": _filtered(attributes={"db.system": "redis"}),
    "filter_attr_int_as_string": _filtered(attributes={"http.status_code": 500}),
    "filter_attr_resource_fallback": _filtered(attributes={"host.name": "host-3"}),
    "filter_combined": _filtered(kind="server", status="error", min_duration=LOW, since=T1, attributes={"http.method": "GET"}),
    "page_desc_default": _page(),
    "page_asc_offset": _page(order="asc", limit=50, offset=100),
    "page_filtered": _page(status="error", limit=30, offset=10),
    "page_result_meta_exact": _meta(status="error", limit=50, offset=20),
    "page_result_meta_probe": _meta(status="error", limit=50, offset=20, count_total=False),
    "trace_lookup": lambda s, d: _cols(S.trace(order_spans(s, d), SOME_TRACE)),
    "services": lambda s, d: S.services(order_spans(s, d)),
    "operations": lambda s, d: S.operations(order_spans(s, d), "supplier-3"),
    "trace_summary": lambda s, d: S.trace_summaries(order_spans(s, d)),
    "trace_parent_edges": lambda s, d: S.parent_edges(event_spans(s, d)),
    "term_index": lambda s, d: B.term_index(order_spans(s, d), B.day_block()),
    "block_division": lambda s, d: B.matching_blocks(B.term_index(order_spans(s, d), B.day_block()), ["status:error", "service.name:furniture"]),
    "block_manifest": lambda s, d: B.manifest(order_spans(s, d), B.day_block()),
    "block_time_overlap": lambda s, d: B.overlapping(_day_blocks(s, d), T1, T2).select("block_id", "entry_count"),
    "block_lookup_trace": lambda s, d: table(s, d, "trace_index").select("trace_id", "block_id").where("trace_id is not null").distinct().join(_blocks(s, d).select("block_id", "block_format"), "block_id"),
    "stats_by_format": lambda s, d: B.stats_by_format(_blocks(s, d)),
    "stats_raw_backlog": lambda s, d: B.raw_backlog(_blocks(s, d)).select("n_blocks", "n_entries"),
    "block_term_counts": lambda s, d: _day_blocks(s, d).join(B.term_index(order_spans(s, d), B.day_block()).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_terms")), "block_id", "left").select("block_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms")),
    "retention_by_age": lambda s, d: B.expired_by_age(_day_blocks(s, d), T1).select("block_id"),
    "retention_by_size": lambda s, d: B.expired_by_size(_day_blocks(s, d), 1_000_000).select("block_id"),
    "retention_by_terms": lambda s, d: B.expired_by_terms(_day_blocks(s, d), B.term_index(order_spans(s, d), B.day_block()), 20_000).select("block_id"),
    "retention_delete": lambda s, d: B.delete_blocks(_day_blocks(s, d), B.expired_by_age(_day_blocks(s, d), T1)).select("block_id", "entry_count"),
    "manifest_upsert": lambda s, d: B.upsert(_blocks(s, d).select("block_id", "block_format"), _blocks(s, d).where("block_format = 'raw'").select("block_id", F.lit("zst").alias("block_format")), ["block_id"]),
    "merge_candidates": lambda s, d: B.merge_candidates(_blocks(s, d).where("block_format <> 'raw'"), 40).select("block_id", "entry_count", "ts_min"),
    "jaeger_spans": _jaeger_spans,
    "jaeger_processes": _processes,
    "jaeger_process_tags": _process_tags,
    "jaeger_tags_typed": _span_tags,
    "jaeger_search_page": _search_page,
    "jaeger_trace_json": _jaeger_json,
    "jaeger_trace_documents": _jaeger_documents,
    "event_logs": _logs,
    "id_codec": _ids,
    "otlp_decode": _otlp,
    "otlp_attributes": _otlp_attributes,
    "otlp_events": _otlp_events,
    "rest_layout": _rest,
    "store_trace": _store_trace,
    "store_search": _store_search,
    "store_page": _store_page,
    "store_services": lambda s, d: _store(s, d).store.services(),
    "store_operations": lambda s, d: S.operations(_store(s, d)._spans({"service": "supplier-3"}), "supplier-3"),
    "store_concurrent": _store_concurrent,
    "store_early_page": _store_early_page,
    "store_retention": _store_retention,
    "store_block_spans": _block_spans,
    "memory_search": _memory,
    "otlp_protobuf": _protobuf,
    "stream_ingest": _stream_ingest,
    "page_after": _page_after,
    "jaeger_search_range": _search_range,
    "store_backup": _store_backup,
    "store_counters": _store_counters,
    "block_formats": lambda s, d: _blocks(s, d).select("block_id", B.format_of("file_path").alias("block_format")),
    "postings_insert_new": lambda s, d: B.insert_new(*(table(s, d, "trace_index").where(f"block_id % 3 {op}").select("trace_id", "block_id") for op in ("<> 0", "<> 1"))),
    "enum_codes": lambda s, d: table(s, d, "spans").select("recv_no", E.kind_code(E.norm_kind("kind")).cast("long").alias("kind_code"), E.status_code(E.norm_status("status")).cast("long").alias("status_code"), E.kind_name(E.kind_code(E.norm_kind("kind"))).alias("kind"), E.status_name(E.status_code(E.norm_status("status"))).alias("status")),
    "shard_balance": _shards,
    "stream_tail_error": _tail,
    "compaction_invariance": _compaction(lambda x: x),
}

# --- SQL ----------------------------------------------------------------------

_NS = "epoch_us({0}) * 1000"
_S_CTE = f"""s as (select t.*, t.start_time + t.duration_ns as end_time, coalesce(attr_service, res_service) as service from (
  select lower(lpad(hex(o_orderkey), 32, '0')) as trace_id, lower(lpad(hex(o_orderkey * 16), 16, '0')) as span_id, cast(null as varchar) as parent_span_id,
    concat('order ', lower(o_orderpriority)) as name, 'server' as kind, {_NS.format("o_orderdate")} as start_time,
    cast(round(o_totalprice * 100) as bigint) * 10000 as duration_ns,
    case o_orderstatus when 'F' then 'ok' when 'P' then 'error' else 'unset' end as status, case when o_orderstatus = 'P' then 'partial order' end as status_message,
    lower(c_mktsegment) as attr_service, case when o_orderpriority = '1-URGENT' then 'POST' else 'GET' end as attr_http_method,
    cast(case o_orderstatus when 'F' then 200 when 'P' then 500 else 202 end as bigint) as attr_http_status_code, cast(null as varchar) as attr_db_system,
    'gateway' as res_service, concat('host-', cast(o_custkey % 5 as varchar)) as res_host_name
  from orders join customer on o_custkey = c_custkey
  union all
  select lower(lpad(hex(l_orderkey), 32, '0')), lower(lpad(hex(l_orderkey * 16 + l_linenumber), 16, '0')), lower(lpad(hex(l_orderkey * 16), 16, '0')),
    concat('line ', lower(l_returnflag)), case when l_linenumber % 2 = 0 then 'client' else 'internal' end, {_NS.format("l_shipdate")},
    cast(round(l_extendedprice * 100) as bigint) * 10000, case l_linestatus when 'F' then 'ok' else 'unset' end, null, null, null, null,
    case l_returnflag when 'A' then 'postgresql' when 'N' then 'redis' else 'mysql' end, concat('supplier-', cast(l_suppkey % 10 as varchar)), concat('host-', cast(l_partkey % 5 as varchar))
  from lineitem) t)"""
_E_CTE = f"""e as (select lower(lpad(hex(user_id), 32, '0')) as trace_id, lower(lpad(hex(event_id), 16, '0')) as span_id,
  case when row_number() over w = 1 then null else lower(lpad(hex(first_value(event_id) over w), 16, '0')) end as parent_span_id, event_type as name,
  case event_type when 'view' then 'server' when 'click' then 'client' when 'signup' then 'producer' when 'purchase' then 'consumer' else 'internal' end as kind,
  {_NS.format("ts")} as start_time, cast(round(value * 100) as bigint) * 10000 as duration_ns,
  case event_type when 'error' then 'error' when 'purchase' then 'ok' else 'unset' end as status,
  concat('shard-', cast(user_id % 4 as varchar)) as service, json_extract_string(props, '$.k') as attr_k
  from events window w as (partition by user_id order by ts, event_id))"""
_SC = "trace_id, span_id, parent_span_id, name, kind, start_time, end_time, duration_ns, status, status_message, service"
_ORDER = "trace_id, span_id, duration_ns, name, kind, status, service"
_DAY = "start_time // 86400000000000"
_TERMS = f"""tm as (select distinct {_DAY} block_id, unnest([x for x in ['name:' || name, 'kind:' || kind, 'status:' || status, 'service.name:' || service, 'host.name:' || res_host_name,
  'http.method:' || attr_http_method, 'http.status_code:' || cast(attr_http_status_code as varchar), 'db.system:' || attr_db_system] if x is not null]) term from s)"""
_MAN = f"b as (select {_DAY} block_id, count(*) entry_count, min(start_time) ts_min, max(start_time) ts_max, cast(count(*) * 100 as bigint) byte_size from s group by 1)"
_LIVE = """b as (select * exclude (rn) from (select *, row_number() over (partition by block_id order by created_at desc, byte_size desc, entry_count desc) rn from blocks where deleted_at is null and block_id is not null) where rn = 1)"""


def _s(q: str) -> str:
    return f"with {_S_CTE} {q}"


def _f(cond: str) -> str:
    return _s(f"select {_SC} from s where {cond}")


def _over(weight: str, most: int) -> str:
    return f"select block_id from (select block_id, sum({weight}) over () - coalesce(sum({weight}) over (order by ts_min, block_id rows between unbounded preceding and 1 preceding), 0) r from x) where r > {most}"


def _enum_sql(c: str, prefix: str, known: list[str], default: str) -> str:
    v = f"regexp_replace(lower(trim({c})), '^{prefix}', '')"
    return f"case when {v} in ({', '.join(repr(k) for k in known)}) then {v} else '{default}' end"


SQL = {
    "spans_all_count": _s("select count(*) n from s"),
    "filter_status_error": _f("status = 'error'"),
    "filter_kind_server": _f("kind = 'server'"),
    "filter_service": _f("service = 'furniture'"),
    "filter_name_ci": _f("contains(lower(concat_ws('|', name, attr_service, attr_http_method, attr_db_system)), 'urgent')"),
    "filter_name_attribute": _f("contains(lower(concat_ws('|', name, attr_service, attr_http_method, attr_db_system)), 'sql')"),
    "filter_duration_range": _f(f"duration_ns between {LOW} and {HIGH}"),
    "filter_time_range": _f(f"start_time between {T1} and {T2}"),
    "filter_trace_id": _f(f"trace_id = '{SOME_TRACE}'"),
    "filter_attr_string": _f("attr_db_system = 'redis'"),
    "filter_attr_int_as_string": _f("cast(attr_http_status_code as varchar) = '500'"),
    "filter_attr_resource_fallback": _f("res_host_name = 'host-3'"),
    "filter_combined": _f(f"kind = 'server' and status = 'error' and duration_ns >= {LOW} and start_time >= {T1} and attr_http_method = 'GET'"),
    "page_desc_default": _s(f"select {_SC} from s order by start_time desc, {_ORDER} limit 100"),
    "page_asc_offset": _s(f"select {_SC} from s order by start_time, {_ORDER} limit 50 offset 100"),
    "page_filtered": _s(f"select {_SC} from s where status = 'error' order by start_time desc, {_ORDER} limit 30 offset 10"),
    "page_result_meta_exact": _s('select count(*) total, 50::bigint "limit", 20::bigint "offset", count(*) > 70 has_more from s where status = \'error\''),
    "page_result_meta_probe": _s('select cast(20 + greatest(0, least(count(*) - 20, 50)) + (count(*) > 70)::int as bigint) total, 50::bigint "limit", 20::bigint "offset", count(*) > 70 has_more from s where status = \'error\''),
    "trace_lookup": _f(f"trace_id = '{SOME_TRACE}'"),
    "services": _s("select distinct service from s where service is not null"),
    "operations": _s("select distinct name operation from s where service = 'supplier-3'"),
    "trace_summary": _s("select trace_id, count(*) span_count, arg_min(name, row(case when parent_span_id is null then 0 else 1 end, start_time, span_id, name)) root_name, max(end_time) - min(start_time) duration_ns, bool_or(status = 'error') has_error from s group by 1"),
    "trace_parent_edges": f"with {_E_CTE} select trace_id, span_id, parent_span_id from e where parent_span_id is not null",
    "term_index": _s(f", {_TERMS} select block_id, term from tm"),
    "block_division": _s(f", {_TERMS} select block_id from tm where term in ('status:error', 'service.name:furniture') group by 1 having count(distinct term) = 2"),
    "block_manifest": _s(f", {_MAN} select block_id, entry_count, ts_min, ts_max from b"),
    "block_time_overlap": _s(f", {_MAN} select block_id, entry_count from b where ts_max >= {T1} and ts_min <= {T2}"),
    "block_lookup_trace": f"with {_LIVE} select distinct t.trace_id, b.block_id, b.block_format from trace_index t join b on t.block_id = b.block_id where t.trace_id is not null",
    "stats_by_format": f"""with {_LIVE} select case when grouping(block_format) = 1 then '*' else coalesce(block_format, '') end block_format, count(*) n_blocks, cast(sum(entry_count) as bigint) n_entries,
  cast(sum(byte_size) as bigint) n_bytes, min(ts_min) ts_min, max(ts_max) ts_max from b group by grouping sets ((block_format), ())""",
    "stats_raw_backlog": f"with {_LIVE} select count(*) n_blocks, cast(coalesce(sum(entry_count), 0) as bigint) n_entries from b where block_format = 'raw'",
    "block_term_counts": _s(f", {_TERMS} select block_id, count(*) n_terms from tm group by 1"),
    "retention_by_age": _s(f", {_MAN} select block_id from b where ts_max < {T1}"),
    "retention_by_size": _s(f", {_MAN}, x as (select * from b) {_over('byte_size', 1_000_000)}"),
    "retention_by_terms": _s(f", {_TERMS}, {_MAN}, x as (select b.*, n_terms from b join (select block_id, count(*) n_terms from tm group by 1) using (block_id)) {_over('n_terms', 20_000)}"),
    "retention_delete": _s(f", {_MAN} select block_id, entry_count from b where ts_max >= {T1}"),
    "manifest_upsert": f"with {_LIVE} select block_id, case when block_format = 'raw' then 'zst' else block_format end block_format from b",
    "merge_candidates": f"with {_LIVE} select block_id, entry_count, ts_min from b where block_format <> 'raw' and entry_count < 40",
    "jaeger_spans": _s(f"""select trace_id "traceID", span_id "spanID", name "operationName", start_time // 1000 "startTime", duration_ns // 1000 "duration",
  'p' || dense_rank() over (partition by trace_id order by service) "processID", (parent_span_id is not null)::bigint n_refs, parent_span_id parent, upper(status) status,
  2 + (status_message is not null)::bigint + (attr_service is not null)::bigint + (attr_http_method is not null)::bigint + (attr_http_status_code is not null)::bigint + (attr_db_system is not null)::bigint n_tags from s"""),
    "jaeger_processes": _s("select distinct trace_id, service, 'p' || dense_rank() over (partition by trace_id order by service) process_id from s"),
    "jaeger_process_tags": _s("select trace_id, service, 'host.name' as key, 'string' as type, arg_max(res_host_name, row(start_time, span_id, res_host_name)) as value from s group by 1, 2"),
    "jaeger_tags_typed": f"""with {_S_CTE}, {_E_CTE}, u as (select span_id, kind, status, null::varchar status_message, null::varchar attr_service, null::varchar attr_http_method, null::bigint attr_http_status_code, null::varchar attr_db_system, attr_k from e
  union all select span_id, kind, status, status_message, attr_service, attr_http_method, attr_http_status_code, attr_db_system, null from s)
select span_id, 'span.kind' as key, 'string' as type, kind as value from u union all select span_id, 'otel.status_code', 'string', upper(status) from u
union all select span_id, 'otel.status_description', 'string', status_message from u where status_message is not null
union all select span_id, 'service.name', 'string', attr_service from u where attr_service is not null
union all select span_id, 'http.method', 'string', attr_http_method from u where attr_http_method is not null
union all select span_id, 'http.status_code', 'int64', cast(attr_http_status_code as varchar) from u where attr_http_status_code is not null
union all select span_id, 'db.system', 'string', attr_db_system from u where attr_db_system is not null
union all select span_id, 'k', 'string', attr_k from u where attr_k is not null""",
    "jaeger_search_page": _s(f", p as (select * from s where service = 'furniture' and duration_ns >= 1000000000 order by start_time desc, {_ORDER} limit 50) select trace_id, count(*) n_spans from p group by 1"),
    "jaeger_trace_json": f"""with {_E_CTE}, j as (select *, to_json(attr_k) k, start_time // 1000 us, replace(name, '"', '') nm from e)
select span_id trace_id, '{{"traceID":"' || span_id || '","spans":[{{"traceID":"' || span_id || '","spanID":"' || span_id || '","operationName":"' || nm || '","references":[' ||
  case when parent_span_id is null then '' else '{{"refType":"CHILD_OF","traceID":"' || span_id || '","spanID":"' || parent_span_id || '"}}' end || '],"startTime":' || us || ',"duration":' || duration_ns // 1000 ||
  ',"tags":[{{"key":"span.kind","type":"string","value":"' || kind || '"}},{{"key":"otel.status_code","type":"string","value":"' || upper(status) || '"}}' || case when attr_k is null then '' else ',{{"key":"k","type":"string","value":' || k || '}}' end ||
  '],"logs":[{{"timestamp":' || us || ',"fields":[{{"key":"event","type":"string","value":"' || nm || '"}}' || case when attr_k is null then '' else ',{{"key":"k","type":"string","value":' || k || '}}' end ||
  ']}}],"processID":"p1","warnings":null}}],"processes":{{"p1":{{"serviceName":"' || service || '","tags":[]}}}},"warnings":null}}' json from j""",
    "jaeger_trace_documents": _s("""select trace_id, row_number() over (partition by trace_id order by start_time // 1000, span_id, duration_ns // 1000, name, service) - 1 place, span_id, name, start_time // 1000 start_us, duration_ns // 1000 duration_us, parent_span_id parent, service,
  arg_max(res_host_name, row(start_time, span_id, res_host_name)) over (partition by trace_id, service) host,
  2 + (status_message is not null)::bigint + (attr_service is not null)::bigint + (attr_http_method is not null)::bigint + (attr_http_status_code is not null)::bigint + (attr_db_system is not null)::bigint n_tags,
  case when attr_http_status_code is null then '' else 'int64 ' || attr_http_status_code end code from s"""),
    "event_logs": f"with {_E_CTE} select span_id, start_time // 1000 ts_us, 'event' as key, name as value from e union all select span_id, start_time // 1000, 'k', attr_k from e where attr_k is not null",
    "id_codec": "select o_orderkey, lower(lpad(hex(o_orderkey), 32, '0')) trace_hex, lower(lpad(hex(o_orderkey), 16, '0')) span_hex, cast(octet_length(unhex(lpad(hex(o_orderkey), 32, '0'))) as bigint) n_bytes, lower(hex(unhex(lpad(hex(o_orderkey), 32, '0')))) round_trip from orders",
    "stream_tail_error": "select event_id, event_type as name, 'error' as status, user_id from events where event_type = 'error'",
    "compaction_invariance": f"""with {_S_CTE}, {_E_CTE}, u as (select status, kind, duration_ns, start_time from e union all select status, kind, duration_ns, start_time from s)
select status, kind, count(*) n, cast(sum(duration_ns) as bigint) total_ns, min(start_time) "first", max(start_time) "last" from u group by 1, 2""",
    **{k: payload_sql.SQL[k] for k in ("otlp_decode", "otlp_attributes", "otlp_events")},
    "rest_layout": _s(f"select {_SC} from s"),
    "store_trace": _f(f"trace_id = '{SOME_TRACE}'"),
    "store_search": _f(f"service = 'furniture' and status = 'error' and start_time >= {T1}"),
    "store_page": _s(f"select {_SC}, (select count(*) from s) total from s order by start_time desc, {_ORDER} limit 100"),
    "store_early_page": _s(f"select {_SC}, true has_more from s where status = 'error' order by start_time desc, {_ORDER} limit 40 offset 5"),
    "store_retention": _s(f"select count(*) n, cast(sum(duration_ns) as bigint) total_ns, true no_older_block from s where start_time >= {T1}"),
    "memory_search": _f("kind = 'client' and attr_db_system = 'redis'"),
    "otlp_protobuf": _s(f"select {_SC} from s"),
    "page_after": _s(f"select {_SC} from s where status = 'error' order by start_time desc, {_ORDER} limit 30 offset 60"),
    "jaeger_search_range": _s(f"select {_SC} from s where service = 'building' and contains(lower(concat_ws('|', name, attr_service, attr_http_method, attr_db_system)), 'order') and start_time between {T1} and {T2 // 1000 * 1000} and duration_ns between 2000000000 and 900000000000 order by start_time desc, {_ORDER} limit 70"),
    "store_services": _s("select distinct service from (select service from s) where service is not null"),
    "store_operations": _s("select distinct name operation from s where service = 'supplier-3'"),
    "store_counters": _s("select count(*) n_entries, 2::bigint compactions, true sizes_agree, true smaller from s"),
    "store_backup": _s("select status, kind, count(*) n, cast(sum(duration_ns) as bigint) total_ns, min(start_time) \"first\", max(start_time) \"last\" from s group by 1, 2"),
    "block_formats": f"with {_LIVE} select block_id, case regexp_extract(file_path, '\\.([a-z]+)$', 1) when 'raw' then 'raw' when 'zst' then 'zstd' when 'ozl' then 'openzl' end block_format from b",
    "postings_insert_new": "select distinct trace_id, block_id from trace_index where block_id is not null",
    "enum_codes": f"""with x as (select recv_no, {_enum_sql("kind", "span_kind_", E.KINDS, "internal")} kind, {_enum_sql("status", "status_code_", E.STATUSES, "unset")} status from spans)
select recv_no, cast(list_position({E.KINDS}, kind) - 1 as bigint) kind_code, cast(list_position({E.STATUSES}, status) - 1 as bigint) status_code, kind, status from x""",
    "shard_balance": _s("select count(*) n_spans, count(distinct trace_id) n_traces, 4::bigint n_shards, true one_shard_each from s"),
}
SQL["store_concurrent"] = SQL["compaction_invariance"]
SQL["store_block_spans"] = SQL["store_backup"]
SQL["stream_ingest"] = f"select {', '.join(COLS)} from ({payload_sql.SQL['otlp_decode']})"
