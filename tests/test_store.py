import gzip
import json
import shutil
import struct
import threading
import time
import urllib.request
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spanloom.config import EngineConfig
from spanloom.engine import Engine
from spanloom.functions.enums import kind_code, kind_name, status_code, status_name
from spanloom.functions.ids import binary_hex, lookup_keys, pack_id, span_hex, trace_hex
from spanloom.operators import blocks as B
from spanloom.plans import span_queries as Q
from spanloom.sources.http import handle, serve
from spanloom.sources.otlp import decode_json, decode_protobuf, parse_protobuf
from spanloom.sources.sdk import Exporter, from_rest
from spanloom.sources.store import CorruptBlock, SpanStore, UnknownVersion, _by_ranges, _signature_bits, signature_of
from spanloom.streaming.buffer import Buffer
from spanloom.streaming.ingest import ingest, payload_stream, shard, tail
from test_search import SHAPE, frame, span

CONF = EngineConfig(compaction_threshold=10, merge_target=40, retention_max_age_s=None)


@pytest.fixture
def store(spark, tmp_path):
    return SpanStore(spark, str(tmp_path / "store"), CONF)


def put(spark, store, lo, hi, **k):
    return store.append(spark.createDataFrame([span(i, trace=f"t{i % 5}", **k) for i in range(lo, hi)], SHAPE).coalesce(1))


def view(store):
    return rows(store.spans().select("trace_id", "span_id", "start_time", "service_name"))


def test_compaction_and_merge_keep_everything(spark, store):
    assert store.compact() == "noop" and store.merge() == "noop"
    for k in range(3):
        put(spark, store, 8 * k, 8 * k + 8)
    before = view(store)
    assert store.manifest().count() == 3 and len(before) == 24
    assert store.compact() == "ok" and view(store) == before
    assert {r.block_format for r in store.manifest().collect()} == {"zstd"}
    for k in range(3, 7):
        put(spark, store, 8 * k, 8 * k + 8)
        store.compact(force=True)
    before = view(store)
    assert store.merge() == "ok" and view(store) == before
    assert store.counters()["compactions"] > 4
    again = SpanStore(spark, store.root, CONF)
    assert view(again) == before and again.stats().where("block_format = '*'").first().n_entries == 56
    assert store.matching_block_ids(["service.name:api", "kind:server"]) and not store.matching_block_ids(["service.name:zz"])
    assert len(store.matching_block_ids(since=10**12)) == 0
    assert [r.span_id for r in store.newest(3).orderBy("start_time").collect()][-3:] == ["s053", "s054", "s055"]


def test_repeated_append_by_name_replaces(spark, store):
    df = spark.createDataFrame([span(1), span(2)], SHAPE)
    assert store.append(df, "batch-1") == 2 and store.append(df, "batch-1") == 2
    assert len(view(store)) == 2
    assert store.append(df.limit(0)) == 0


def test_missing_and_corrupt_blocks(spark, store, tmp_path):
    put(spark, store, 0, 3)
    put(spark, store, 3, 6)
    put(spark, store, 6, 9)
    files = [r.file_path for r in store.manifest().orderBy("ts_min").collect()]
    (tmp_path / "store" / files[0]).unlink()
    told = []
    store.note = lambda event, **what: told.append((event, what.get("file_path")))
    assert len(view(store)) == 6 and told == [("block.missing", files[0])] and store.manifest().count() == 2
    put(spark, store, 0, 3)
    (tmp_path / "store" / store.manifest().orderBy("ts_min").first().file_path).unlink()
    assert store.reconcile() == 1 and store.manifest().count() == 2
    bad = tmp_path / "store" / files[1]
    (bad.parent / f".{bad.name}.crc").unlink(missing_ok=True)
    bad.write_bytes(b"no parquet")
    assert len(view(store)) == 3
    with pytest.raises(CorruptBlock):
        store.compact(force=True)
    assert store.manifest().count() == 2 and bad.exists()
    assert [(b, n, k) for b, n, k in store.verify()] == [(files[1].removeprefix("blocks/"), 3, 0)] and told[-1][0] == "block.error"


def test_writers_lose_nothing(spark, store):
    """Two writers and a compaction at once: whatever was acknowledged is there once."""
    other, acked, failed = SpanStore(spark, store.root, CONF), [], []

    def write(s, lo):
        try:
            for k in range(4):
                acked.append(s.append(spark.createDataFrame([span(i, trace=f"t{i % 5}") for i in range(lo + 100 * k, lo + 100 * k + 100)], SHAPE).coalesce(1)))
        except Exception as e:
            failed.append(e)

    # the first two share one store object
    threads = [threading.Thread(target=write, args=(s, lo)) for s, lo in ((store, 0), (store, 400), (other, 800))]
    for t in threads:
        t.start()
    third = SpanStore(spark, store.root, CONF)
    for _ in range(3):
        third.compact(force=True)
    for t in threads:
        t.join()
    assert not failed and sum(acked) == 1200
    got = [r.span_id for r in store.spans().select("span_id").collect()]
    assert sorted(got) == sorted(f"s{i:03d}" for i in range(1200))
    assert store.spans().count() == other.spans().count() == 1200
    # two compactions of the same blocks: one of them wins
    put(spark, store, 1900, 1905)
    results = []
    pair = [threading.Thread(target=lambda s=s: results.append(s.compact(force=True))) for s in (store, other)]
    for t in pair:
        t.start()
    for t in pair:
        t.join()
    assert "ok" in results and SpanStore(spark, store.root, CONF).spans().count() == 1205


def test_open_reader_outlives_compaction_until_vacuum(spark, store):
    for k in range(3):
        put(spark, store, 100 * k, 100 * k + 100)
    held, listed = store.spans(), store.manifest()
    assert store.compact(force=True) == "ok" and store.vacuum() == 0
    assert held.count() == 300 and listed.count() == 3
    assert store.vacuum(older_than_s=0) == 3 and store.vacuum(older_than_s=0) == 0
    with pytest.raises(Exception, match="(?i)not exist|no such file|FILE_NOT_EXIST"):
        held.select("span_id").collect()
    assert len(view(store)) == 300 and store.trace(["t1"]).where("trace_id = 't1'").count() == 60


def test_checkpoints_and_versions(spark, store, tmp_path):
    for k in range(22):
        put(spark, store, k, k + 1)
    assert store.delete_before(2_000) == 2
    again = SpanStore(spark, store.root, CONF)
    assert again.refresh() == 23 and len(view(again)) == 20 and again.counters() == store.counters()
    assert json.loads((tmp_path / "store/log/checkpoint").read_text())["version"] == 20
    (tmp_path / "store/log" / f"{24:020d}.json").write_text(json.dumps({"format": 99}))
    with pytest.raises(UnknownVersion):
        again.refresh()


def test_store_queries_write_by_as_many_tasks_as_there_are_parts(spark, data, tmp_path):
    for name in ("orders", "lineitem", "customer"):
        spark.read.parquet(f"{data}/{name}.parquet").repartition(6).write.parquet(str(tmp_path / f"{name}.parquet"))
    store = Q._store(spark, str(tmp_path)).store
    assert store.manifest().where("block_format = 'raw'").count() >= 6  # was 2 of any input
    x = Q.order_spans(spark, data)
    assert rows(store.spans().select("trace_id", "span_id", "start_time", "service_name", "p_db_system")) == rows(x.select("trace_id", "span_id", "start_time", "service_name", "p_db_system"))
    pairs = store.spans().withColumn("block_id", F.regexp_extract(F.col("_metadata.file_path"), "blocks/([^/]+/[^/]+)$", 1))
    pairs = pairs.groupBy("trace_id", "block_id").agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"))
    live = store.live()
    index = spark.read.parquet(*{f"{store.root}/index/{s}/traces" for s in live["segment"].to_pylist()})
    assert rows(index.select("trace_id", "block_id", "lo", "hi")) == rows(pairs)


def test_ranges_follow_each_other_and_hold_all(spark):
    x = spark.range(0, 4000, 1, 5).select(F.when(F.col("id") % 100 > 0, F.pmod(F.xxhash64("id"), F.lit(10**12))).alias("k"), F.col("id").alias("v"))
    got = _by_ranges(x, "k", 13)
    assert "rangepartitioning" not in got._jdf.queryExecution().toString().lower()  # would go through all columns to find its bounds
    assert rows(got) == rows(x)
    parts = got.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("none")).orderBy("p").collect()
    assert len(parts) == 13 and all(a.hi < b.lo for a, b in zip(parts, parts[1:], strict=False)) and max(r.n for r in parts) < 500
    assert [r.none for r in parts] == [40, *[0] * 12]
    for same in (F.lit(7).cast("long"), F.lit(None).cast("long")):
        y = x.withColumn("k", same)
        assert rows(_by_ranges(y, "k", 5)) == rows(y)


def test_a_store_of_the_first_format_is_taken_over(spark, store, tmp_path):
    put(spark, store, 0, 5)
    old = tmp_path / "old"
    m = store.manifest().drop("n_terms")
    shutil.copytree(tmp_path / "store/blocks", old / "blocks")
    m.coalesce(1).write.parquet(str(old / "manifest/m1"))
    (old / "CURRENT").write_text(json.dumps({"version": 1, "name": "m1", "counters": {"raw_in": 7, "compressed_out": 3, "compactions": 1}}))
    got = SpanStore(spark, str(old), CONF)
    assert view(got) == view(store) and got.counters()["raw_in"] == 7
    assert got.trace(["t1"]).where("trace_id = 't1'").count() == 1 and got.spans(terms=["kind:server"]).count() == 5
    put(spark, got, 5, 8)
    assert got.compact(force=True) == "ok" and len(view(SpanStore(spark, str(old), CONF))) == 8


def test_index_rules_blocks_out(spark, store):
    put(spark, store, 0, 10)
    store.append(spark.createDataFrame([span(i, trace="other", kind="client", attrs={"host": "h1"}, res={"service.name": "db", "host": "h2"}) for i in range(20, 30)], SHAPE).coalesce(1))
    assert [t["entry_count"].to_pylist() for t in (store.pruned(terms=["kind:client"]), store.pruned(terms=["host:h1", "host:h2"]), store.pruned(terms=["kind:none"]))] == [[10], [10], []]
    assert store.trace_blocks(["other"]).num_rows == 1 and store.trace_blocks(["t1"]).num_rows == 1 and store.trace_blocks(["zz"]).num_rows == 0
    want = {(r.block_id, r.term) for r in B.term_index(store.spans(), F.regexp_extract(F.col("_metadata")["file_path"], "blocks/(.*)", 1)).collect()}
    assert {(r.block_id, r.term) for r in store.term_index().collect()} == want and any(t == "host:h2" for _, t in want)
    slow = {(r.block_id, r.term) for r in store.spans().select(F.regexp_extract(F.col("_metadata")["file_path"], "blocks/(.*)", 1).alias("block_id"), F.explode(B.terms()).alias("term")).distinct().collect()}
    assert slow == want
    terms = ["kind:server", "name:ü", "x"]
    bits = spark.range(1).select(_signature_bits(F.array(*map(F.lit, terms)))).first()[0]
    assert sum(1 << b for b in bits) == signature_of(terms)
    many = SpanStore(spark, store.root, CONF)
    from spanloom.sources import store as module

    direct, module.DIRECT_SEGMENTS = module.DIRECT_SEGMENTS, 0  # the ways of large stores
    try:
        assert many.trace_blocks(["other"]).num_rows == 1 and many.spans(terms=["kind:client"]).count() == 10
    finally:
        module.DIRECT_SEGMENTS = direct


def test_engine_early_exit_memory_and_background(spark, tmp_path):
    conf = replace(CONF, compaction_interval_s=0.2, retention_interval_s=0.3, vacuum_after_s=0.0, buffer_shards=2, flush_interval_s=0.2)
    e, m = Engine(spark, str(tmp_path / "e"), conf), Engine(spark, config=replace(conf, storage="memory"))
    df = [span(i, trace=f"t{i % 5}", status="error" if i % 3 else "ok") for i in range(60)]
    for lo in range(0, 60, 10):
        for x in (e, m):
            assert x.ingest(spark.createDataFrame(df[lo : lo + 10], SHAPE).coalesce(1)) == 10
    for f in ({}, {"limit": 7}, {"limit": 5, "offset": 3, "count_total": False}, {"status": "error", "limit": 4, "count_total": False}, {"status": "ok", "limit": 50, "count_total": False}, {"since": 30_000, "limit": 3, "count_total": False}, {"order": "asc", "limit": 3}, {"service": "none"}):
        a, b = e.query(f), m.query(f)
        assert [r.span_id for r in a.entries] == [r.span_id for r in b.entries] and (a.total, a.has_more) == (b.total, b.has_more), f
    assert [r.span_id for r in e.trace("t3").collect()] == [r.span_id for r in m.trace("t3").collect()] == [f"s{i:03d}" for i in range(3, 60, 5)]
    assert m.services() == e.services() == ["api"] and m.operations("api") == ["HTTP GET /users"]
    e.start()
    for _ in range(100):
        if "retention.stop" in {k for k, _ in e.events} and ("compaction.stop", "ok") in {(k, w.get("result")) for k, w in e.events}:
            break
        time.sleep(0.1)
    e.accept(json.dumps(BODY).encode(), False, 2)
    e.stop()
    e.merge()
    assert e.query({"limit": 0}).total == 62 and {"compaction.stop", "merge.stop", "retention.stop", "flush.stop", "query.stop"} <= {k for k, _ in e.events}
    with pytest.raises(Exception, match="(?i)cancel"):
        replace_timeout = Engine(spark, str(tmp_path / "e"), replace(conf, query_timeout_s=0.5))
        replace_timeout._timed(lambda: spark.range(10**12).selectExpr("sum(hash(id, id + 1) % 7)").collect())


def test_buffer_flushes_by_size_time_and_keeps_after_failure():
    got, broken = [], [True]

    def write(items):
        if broken[0]:
            raise OSError("disk")
        got.append(items)

    b = Buffer(write, 3, 0.2)
    b.add("a", 1)
    with pytest.raises(OSError):
        b.add("b", 2)
    broken[0] = False
    b.flush()
    b.add("c", 1)
    time.sleep(0.5)
    assert got == [["a", "b"], ["c"]]


def test_sdk_export_and_older_layout(spark, tmp_path):
    n = SimpleNamespace
    ok = n(context=n(trace_id=255, span_id=17), parent=n(span_id=1), name="op", kind=n(value=1), start_time=10, end_time=25, status=n(status_code=n(value=2), description="bad"), attributes={"n": 1, "l": (1, 2)},
           events=[n(name="e", timestamp=5, attributes={"k": "v"})], resource=n(attributes={"service.name": "sdk"}), instrumentation_scope=n(name="lib", version=""))
    root = n(context=n(trace_id=255, span_id=1), parent=None, name="root", kind=0, start_time=1, end_time=None, status=n(status_code=1, description=None), attributes=None, events=None, resource=None)
    e = Engine(spark, str(tmp_path / "s"), CONF)
    assert Exporter(e).export([ok, "no span", root, n(name="half")]) == 2 and Exporter(e).force_flush()
    a, b = e.trace(255).collect()[::-1]
    assert (a.trace_id, a.span_id, a.parent_span_id, a.kind, a.status, a.status_message, a.duration_ns, a.service_name) == ("0" * 30 + "ff", "0" * 14 + "11", "0" * 15 + "1", "server", "error", "bad", 15, "sdk")
    assert {k: v.toPython() for k, v in a.attributes.items()} == {"n": 1, "l": "[1, 2]"} and a.events[0].name == "e" and (b.kind, b.status, b.duration_ns) == ("internal", "ok", 0)
    shape = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time long, end_time long, duration_ns long, status string, rest string"
    rest = json.dumps({"attributes": {"k": 2}, "events": [{"name": "x", "timestamp": 3, "attributes": {}}], "instrumentation_scope": {"name": "l"}})
    a, b = sorted(from_rest(spark.createDataFrame([("t", "1", None, "n", "server", 1, 2, 1, "ok", rest), ("t", "2", None, "n", "server", 1, 2, 1, "ok", None)], shape)).collect(), key=lambda r: r.span_id)
    assert a.attributes["k"].toPython() == 2 and a.events[0].timestamp == 3 and a.instrumentation_scope.name == "l" and b.attributes == {} and b.events == []


def test_codecs(spark):
    df = spark.createDataFrame([(255, "0" * 30 + "ff", "server", "error"), (1, "xyz", "odd", None)], "n long, t string, k string, s string")
    got = df.select(trace_hex("n"), span_hex("n"), binary_hex(pack_id("t")), kind_code("k"), status_code("s"), kind_name(kind_code("k")), status_name(status_code("s")), kind_name(F.lit(99))).collect()
    assert [tuple(r) for r in got] == [("0" * 30 + "ff", "0" * 14 + "ff", "0" * 30 + "ff", 1, 1, "server", "error", "internal"), ("0" * 31 + "1", "0" * 15 + "1", "78797a", 0, 2, "internal", "unset", "internal")]
    assert lookup_keys(255) == lookup_keys(bytes(15) + b"\xff") == ["0" * 30 + "ff"] and lookup_keys("a") == ["a"] == lookup_keys(b"a")


def test_retention_and_backup(spark, store, tmp_path):
    for k in range(4):
        put(spark, store, 10 * k, 10 * k + 10)
    assert store.retain() == "noop"
    copy = store.backup(str(tmp_path / "copy"))
    assert len(copy["files"]) == 4
    store.config = replace(CONF, retention_max_age_s=0)
    assert store.retain(now_ns=15_000)["age"] == 1
    size = store.manifest().agg({"byte_size": "max"}).first()[0]
    store.config = replace(CONF, retention_max_bytes=2 * size)
    assert store.retain()["size"] == 1
    store.config = replace(CONF, retention_max_terms=6)
    assert store.retain()["terms"] == 1 and len(view(store)) == 10
    assert len(view(SpanStore(spark, str(tmp_path / "copy"), CONF))) == 40


BODY = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}]},
            "scopeSpans": [
                {
                    "scope": {"name": "lib", "version": "1"},
                    "spans": [
                        {"traceId": "ab", "spanId": "01", "parentSpanId": "", "name": "GET", "kind": 2, "startTimeUnixNano": "2000", "endTimeUnixNano": 1000, "status": {"code": 1}, "attributes": [{"key": "n", "value": {"intValue": 200}}, {"key": "n", "value": {"intValue": 201}}, {"key": "bad"}, {"key": "arr", "value": {"arrayValue": {"values": []}}}], "events": [{"name": "e", "timeUnixNano": "5x", "attributes": []}]},
                        {"traceId": "ab", "spanId": "02", "parentSpanId": "01", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": "junk", "status": {"code": "STATUS_CODE_ERROR", "message": ""}},
                    ],
                }
            ],
        }
    ]
}


def test_otlp_json(spark):
    df = spark.createDataFrame([(json.dumps(BODY),), (None,), ("not json",), ('{"data":"x"}',)], "body string")
    a, b = sorted(decode_json(df).collect(), key=lambda r: r.span_id)
    assert (a.parent_span_id, a.kind, a.status, a.start_time, a.end_time, a.duration_ns) == (None, "server", "ok", 2000, 1000, -1000)
    assert {k: v.toPython() for k, v in a.attributes.items()} == {"n": 201, "_unknown": "", "arr": '{"arrayValue":{"values":[]}}'}
    assert a.events[0].timestamp == 5 and a.instrumentation_scope.name == "lib" and a.resource["service.name"].toPython() == "web"
    assert (b.parent_span_id, b.kind, b.status, b.start_time, b.name) == ("01", "client", "error", 0, "")


def _v(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _f(no, v):
    if isinstance(v, int):
        return _v(no << 3) + _v(v & (2**64 - 1))
    if isinstance(v, float):
        return _v(no << 3 | 1) + struct.pack("<d", v)
    v = v.encode() if isinstance(v, str) else v
    return _v(no << 3 | 2) + _v(len(v)) + v


def _fix(no, n):
    return _v(no << 3 | 1) + struct.pack("<Q", n)


def request():
    kv = lambda k, v: _f(1, k) + _f(2, v)
    s = _f(1, bytes(range(16))) + _f(2, bytes(range(8))) + _f(5, "op") + _f(6, 3) + _fix(7, 100) + _fix(8, 350)
    s += _f(9, kv("s", _f(1, "x"))) + _f(9, kv("i", _f(3, -7))) + _f(9, kv("d", _f(4, 1.5))) + _f(9, kv("b", _f(2, 1))) + _f(9, kv("y", _f(7, b"\x00\x01"))) + _f(9, kv("a", _f(5, _f(1, _f(1, "q")))))
    s += _f(11, _fix(1, 120) + _f(2, "ev") + _f(3, kv("k", _f(1, "v")))) + _f(15, _f(2, "oops") + _f(3, 2))
    return _f(1, _f(1, _f(1, kv("service.name", _f(1, "svc")))) + _f(2, _f(1, _f(1, "lib") + _f(2, "2")) + _f(2, s)))


def test_otlp_protobuf(spark):
    good = request()
    df = spark.createDataFrame([(bytearray(b),) for b in (good, gzip.compress(good), good[:-3], b"junk!", b"")] + [(None,)], "body binary")
    got = decode_protobuf(df).collect()
    assert len(got) == 2 and {r.span_id for r in got} == {bytes(range(8)).hex()}
    r = got[0]
    assert (r.trace_id, r.span_id, r.parent_span_id, r.kind, r.status, r.status_message, r.duration_ns) == (bytes(range(16)).hex(), bytes(range(8)).hex(), None, "client", "error", "oops", 250)
    assert {k: v.toPython() for k, v in r.attributes.items()} == {"s": "x", "i": -7, "d": 1.5, "b": True, "y": "AAE=", "a": '["q"]'}
    assert (r.events[0].name, r.events[0].timestamp, r.instrumentation_scope.version) == ("ev", 120, "2")
    assert parse_protobuf(b"") == []


def test_http(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"), replace(CONF, bearer_token="secret", max_body_bytes=5000))
    auth = {"authorization": "Bearer secret"}
    assert handle(e, "GET", "/health", {}) == (200, json.dumps({"status": "ok", "blocks": 0, "spans": 0, "disk_size": 0}))
    assert handle(e, "GET", "/select/jaeger/api/services", {})[0] == 401
    assert handle(e, "GET", "/select/jaeger/api/services?token=no", {})[0] == 403
    post = "/insert/opentelemetry/v1/traces"
    for body in (b"not json", b'{"data":"nope"}', b"[]"):
        code, text = handle(e, "POST", post, auth, body)
        assert code == 400
    assert "resourceSpans" in text
    assert handle(e, "POST", post, auth | {"content-type": "application/x-protobuf"}, b"\x0a\xff")[0] == 400
    assert handle(e, "POST", post, auth, b" " * 6000)[0] == 413
    assert handle(e, "POST", post, auth, json.dumps(BODY).encode())[0] == 200
    assert handle(e, "POST", post, auth | {"content-type": "application/x-protobuf"}, request())[0] == 200
    assert handle(e, "GET", "/api/v1/flush", auth)[0] == 200
    assert json.loads(handle(e, "GET", "/select/jaeger/api/services?token=secret", {})[1])["data"] == ["svc", "web"]
    assert json.loads(handle(e, "GET", "/select/jaeger/api/services/web/operations", auth)[1])["data"] == ["", "GET"]
    found = json.loads(handle(e, "GET", "/select/jaeger/api/traces?service=web&limit=5", auth)[1])
    assert found["total"] == 1 and len(found["data"][0]["spans"]) == 2
    assert json.loads(handle(e, "GET", "/select/jaeger/api/traces/ab", auth)[1])["data"][0]["traceID"] == "ab"
    none = json.loads(handle(e, "GET", "/select/jaeger/api/traces/zz", auth)[1])
    assert none["total"] == 1 and none["data"][0]["spans"] == []
    assert handle(e, "GET", "/select/jaeger/api/traces?minDuration=ms", auth)[0] == 400
    assert json.loads(handle(e, "POST", "/api/v1/backup", auth, json.dumps({"path": str(tmp_path / "b")}).encode())[1])["status"] == "ok"
    assert handle(e, "GET", "/api/v1/flush", auth)[0] == 200 and handle(e, "GET", "/x", auth)[0] == 404
    assert e.query({"service": "web"}).total == 2 and e.stats()["total_entries"] == 3
    srv = serve(e, 0)
    threading.Thread(target=srv.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{srv.server_port}/health") as r:
        assert json.load(r)["spans"] == 3
    srv.shutdown()


def test_streams(spark, store, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(3):
        (land / f"{i}.json").write_text(json.dumps(BODY))
    q = ingest(payload_stream(spark, str(land), 2), store, str(tmp_path / "ck"))
    q.awaitTermination()
    assert store.spans().count() == 6
    ingest(payload_stream(spark, str(land), 2), store, str(tmp_path / "ck")).awaitTermination()
    assert store.spans().count() == 6
    src = tmp_path / "src"
    df = frame(spark, [span(i, status="error" if i % 2 else "ok") for i in range(10)])
    df.select("trace_id", "span_id", "status", "service_name", "start_time").write.parquet(str(src))
    got = []
    s = spark.readStream.schema("trace_id string, span_id string, status string, service_name string, start_time long").parquet(str(src))
    tail(s, {"status": "error", "service": "api"}, lambda d, n: got.extend(r.span_id for r in d.collect()), str(tmp_path / "ck2")).awaitTermination()
    assert sorted(got) == ["s001", "s003", "s005", "s007", "s009"]
    parts = shard(df, 4)
    assert parts.select("trace_id", "shard").distinct().count() == 1 and parts.where("shard between 0 and 3").count() == 10
