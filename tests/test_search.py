import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from spanloom.functions.enums import norm_kind, norm_name, norm_status
from spanloom.operators import blocks as B
from spanloom.operators import jaeger as J
from spanloom.operators import search as S
from spanloom.operators.filters import condition, split, to_ns, where
from spanloom.plans.span_queries import QUERIES
from spanloom.runtime import table
from spanloom.sources.schema import from_raw, promote
from spanloom.sources.store import SpanStore

MS = 1_000_000
SHAPE = "trace_id string, span_id string, parent_span_id string, name string, kind string, start_time long, end_time long, duration_ns long, status string, status_message string, attributes map<string,string>, resource map<string,string>"


def span(i, trace="t1", parent=None, name="HTTP GET /users", kind="server", start=None, dur=50 * MS, status="ok", message=None, attrs=None, res=None):
    start = 1000 * i if start is None else start
    return (trace, f"s{i:03d}", parent, name, kind, start, start + (dur or 0), dur, status, message, attrs if attrs is not None else {"http.method": "GET"}, res if res is not None else {"service.name": "api"})


def frame(spark, data):
    return promote(from_raw(spark.createDataFrame(data, SHAPE))).cache()


@pytest.fixture(scope="module")
def combo(spark):
    """18 spans: even ones failed, every third kind client, durations of 1000 ns steps."""
    return frame(spark, [span(i, kind="client" if i % 3 == 0 else "server", status="error" if i % 2 == 0 else "ok", dur=1000 * i) for i in range(18)])


def ids(df):
    return sorted(r["span_id"] for r in df.collect())


def test_each_condition(spark):
    df = frame(spark, [span(1), span(2, name="SELECT", kind="client", status="error", dur=None, attrs={"db.system": "Postgres", "service.name": "db"}), span(3, attrs={}, res={"host.name": "h1"})])
    cases = [
        ({}, [1, 2, 3]), ({"name": "get /"}, [1, 3]), ({"name": "POSTG"}, [2]), ({"name": "%"}, []), ({"service": "db"}, [2]), ({"service": "api"}, [1]), ({"kind": "client"}, [2]),
        ({"status": "error"}, [2]), ({"min_duration": 1}, [1, 3]), ({"max_duration": 0}, [2]), ({"since": 2000, "until": 2000}, [2]), ({"trace_id": "nope"}, []),
        ({"attributes": {"host.name": "h1"}}, [3]), ({"attributes": {"http.method": "GET", "service.name": "api"}}, [1]), ({"unknown": 1}, [1, 2, 3]),
    ]
    for filters, want in cases:
        assert ids(where(df, filters)) == [f"s{i:03d}" for i in want], filters
    assert ids(where(df, [("status", "ok"), ("status", "error")])) == []
    assert condition("unknown", 1, []) is None


def test_typed_values_compare_as_text(spark):
    df = spark.createDataFrame([("a", 200, True)], "span_id string, code long, flag boolean")
    df = df.select("span_id", F.create_map(F.lit("http.status_code"), F.col("code").cast("variant"), F.lit("cached"), F.col("flag").cast("variant")).alias("attributes"))
    df = promote(from_raw(df))
    for v in (200, "200"):
        assert ids(where(df, {"attributes": {"http.status_code": v}})) == ["a"]
    assert ids(where(df, {"attributes": {"cached": True}})) == ["a"]
    assert ids(where(df, {"name": "200"})) == []


def test_combined_and_window(spark, combo):
    got = S.query(combo, {"status": "error", "kind": "server", "min_duration": 2000, "max_duration": 16000, "limit": 3})
    assert got.total == 6 and got.has_more and len(got.entries) == 3
    assert S.query(combo, {"since": 5000, "until": 14000}).total == 10
    t = dt.datetime(1970, 1, 1, 0, 0, 1, 5)
    assert to_ns(t) == 1_000_005_000 and to_ns(7) == 7
    assert split([("limit", 1), ("limit", 2), ("kind", "x")]) == ({"limit": 1}, [("kind", "x")])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(size=st.integers(3, 9), order=st.sampled_from(["asc", "desc"]))
def test_walk_over_pages_is_the_whole_result(combo, size, order):
    whole = [r.span_id for r in S.ordered(combo, order).collect()]
    walk, offset = [], 0
    while True:
        exact = S.query(combo, {"limit": size, "offset": offset, "order": order})
        probe = S.query(combo, {"limit": size, "offset": offset, "order": order, "count_total": False})
        assert [r.span_id for r in exact.entries] == [r.span_id for r in probe.entries] and exact.has_more == probe.has_more
        assert exact.total == 18 and probe.total == offset + len(probe.entries) + probe.has_more
        walk += [r.span_id for r in exact.entries]
        if not exact.has_more:
            break
        offset += size
    assert walk == whole


def test_ties_and_meta(spark):
    df = frame(spark, [span(i, start=123456789, dur=i) for i in range(1, 13)])
    a, b = ([r.span_id for r in S.query(df, {"limit": 4, "offset": 4}).entries] for _ in range(2))
    assert a == b and len(a) == 4
    for exact in (True, False):
        m = S.page_meta(df, {"limit": 4, "offset": 20, "count_total": exact}).first()
        assert (m.total, m.has_more) == ((12, False) if exact else (20, False))
    with pytest.raises(ValueError):
        S.ordered(df, "up")


def test_trace_services_summary(spark):
    df = frame(spark, [span(0, dur=100, name="root"), span(1, parent="s000", start=10, dur=40, status="error", attrs={"service.name": "db"}), span(2, parent="s000", start=20, dur=60), span(9, trace="t2", res={}, attrs={})])
    assert [r.span_id for r in S.trace(df, "t1").collect()] == ["s000", "s001", "s002"]
    assert S.trace(df, "none").collect() == []
    assert rows(S.services(df)) == [("api",), ("db",)]
    assert rows(S.operations(df, "db")) == [("HTTP GET /users",)]
    assert rows(S.trace_summaries(df))[0] == ("t1", 3, "root", 100, True)
    assert rows(S.parent_edges(df)) == [("t1", "s001", "s000"), ("t1", "s002", "s000")]


def test_defaults(spark):
    df = from_raw(spark.createDataFrame([("t", "s", "", 100, 350)], "trace_id string, span_id string, parent_span_id string, start_time long, end_time long"))
    r = df.first()
    assert (r.parent_span_id, r.name, r.kind, r.status, r.duration_ns, r.attributes, r.events, r.resource, r.instrumentation_scope) == (None, "", "internal", "unset", 250, {}, [], {}, None)


def test_enums(spark):
    df = spark.createDataFrame([("Client", "OK", " GET  /v2/x/17 "), ("SPAN_KIND_SERVER", "STATUS_CODE_ERROR", "/1/2/a3"), (None, None, None), ("odd", "odd", "")], "k string, s string, n string")
    assert [tuple(r) for r in df.select(norm_kind("k"), norm_status("s"), norm_name("n")).collect()] == [("client", "ok", "GET /v2/x/{id}"), ("server", "error", "/{id}/{id}/a3"), ("internal", "unset", ""), ("internal", "unset", "")]


def test_jaeger_document(spark):
    df = frame(spark, [span(0, name="root", start=1_500, dur=2_999), span(1, parent="s000", start=2_000, status="error", message="bad", attrs={"service.name": "db", "n": "x"}, res={"service.name": "db", "env": "prod"})])
    df = df.withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("i"), F.lit(42).cast("variant"), F.lit("f"), F.lit(2.5).cast("variant"), F.lit("b"), F.lit(True).cast("variant"))))
    doc = json.loads(J.envelope([r["json"] for r in J.jaeger_traces(df).collect()]))
    assert (doc["total"], doc["limit"], doc["offset"], doc["errors"]) == (1, 0, 0, None)
    t = doc["data"][0]
    a, b = t["spans"]
    assert t["warnings"] is None and a["warnings"] is None
    assert (a["startTime"], a["duration"], a["references"], a["processID"]) == (1, 2, [], "p1")
    assert b["references"] == [{"refType": "CHILD_OF", "traceID": "t1", "spanID": "s000"}] and b["processID"] == "p2"
    tags = {x["key"]: (x["type"], x["value"]) for x in b["tags"]}
    assert tags["span.kind"] == ("string", "server") and tags["otel.status_code"] == ("string", "ERROR") and tags["otel.status_description"] == ("string", "bad")
    assert tags["i"] == ("int64", 42) and tags["f"] == ("float64", 2.5) and tags["b"] == ("bool", True)
    assert t["processes"]["p2"] == {"serviceName": "db", "tags": [{"key": "env", "type": "string", "value": "prod"}]}
    assert J.jaeger_traces(df.limit(0)).collect() == []


def test_jaeger_search_parameters():
    f = J.search_filters({"service": "a", "operation": "o", "start": "5", "end": "7x", "limit": "z", "minDuration": "2ms", "tags": "{}"})
    assert f == [("service", "a"), ("name", "o"), ("since", 5000), ("until", 7000), ("min_duration", 2 * MS)]
    for text, want in (("1ms", MS), ("100us", 100_000), ("2s", 2_000 * MS), ("7", 7), ("1.5ms", MS), ("1m", 1), ("abc", 0)):
        assert J.duration_ns(text) == want
    with pytest.raises(ValueError):
        J.duration_ns("ms")


def test_search_by_trace(spark):
    df = frame(spark, [span(i, trace=f"t{i % 3}") for i in range(12)])
    assert [r.trace_id for r in J.search(df, {"limit": "2"}).collect()] == ["t1", "t2"]
    got = J.search(df, {"limit": "2"}, limit_by="trace").collect()
    assert [len(json.loads(r["json"])["spans"]) for r in got] == [4, 4]


def test_merge_plan():
    assert B.merge_plan([("a", 1), ("b", 1), ("c", 1)]) == []
    assert B.merge_plan([(i, 5) for i in range(5)], 10) == [[0, 1], [2, 3]]
    assert B.merge_plan([(0, 9), (1, 5), (2, 9), (3, 1), (4, 9), (5, 1)], 10) == [[0], [1], [2, 3], [4, 5]]


def test_blocks(spark):
    df = frame(spark, [span(1, attrs={"http.method": "GET", "host": "x"}), span(2, attrs={"db.system": "m"}, res={"host": "y", "db.system": "z"})])
    got = {r.span_id: set(r.t) for r in df.select("span_id", B.terms().alias("t")).collect()}
    assert got["s001"] == {"name:HTTP GET /users", "kind:server", "status:ok", "service.name:api", "host:x", "http.method:GET"}
    assert got["s002"] == {"name:HTTP GET /users", "kind:server", "status:ok", "host:y", "db.system:m"}
    idx = B.term_index(df, F.col("span_id"))
    assert rows(B.matching_blocks(idx, ["kind:server", "host:y"])) == [("s002",)]
    m = spark.createDataFrame([(i, 10, 100 * i, 100 * i + 50) for i in range(5)], "block_id long, byte_size long, ts_min long, ts_max long")
    assert ids_(B.expired_by_size(m, 25)) == [0, 1, 2] and ids_(B.expired_by_size(m, 50)) == [] and ids_(B.expired_by_size(m, 0)) == [0, 1, 2, 3, 4]
    assert ids_(B.expired_by_age(m, 150)) == [0] and ids_(B.overlapping(m, 150, 200)) == [1, 2]


def ids_(df):
    return sorted(r.block_id for r in df.collect())


def test_tags_of_all_spans(spark, data):
    got = {(r["key"], r["type"]): r["n"] for r in QUERIES["jaeger_tags_typed"](spark, data).groupBy("key", "type").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines, orders, events = (table(spark, data, x).count() for x in ("lineitem", "orders", "events"))
    assert got["db.system", "string"] == lines and got["http.status_code", "int64"] == orders
    assert got["span.kind", "string"] == got["otel.status_code", "string"] == lines + orders + events
    assert got["otel.status_description", "string"] == table(spark, data, "orders").where("o_orderstatus = 'P'").count()


def test_compaction_merges_all_spans(spark, data, monkeypatch):
    said, merge = [], SpanStore.merge
    monkeypatch.setattr(SpanStore, "merge", lambda self: said.append(merge(self)) or said[-1])
    lines, orders, events = (table(spark, data, x).count() for x in ("lineitem", "orders", "events"))
    assert QUERIES["compaction_invariance"](spark, data).agg(F.sum("n")).first()[0] == lines + orders + events
    assert said == ["ok"]


def test_documents_of_all_traces(spark, data):
    got = QUERIES["jaeger_trace_documents"](spark, data).agg(F.countDistinct("trace_id"), F.count(F.lit(1)), F.count("service")).first()
    n = table(spark, data, "orders").count() + table(spark, data, "lineitem").count()
    assert tuple(got) == (table(spark, data, "orders").count(), n, n)


def test_query_with_spans_without_start(spark):
    df = frame(spark, [(*span(i)[:5], None if i % 3 == 0 else 1000 * i, *span(i)[6:]) for i in range(12)])
    for order in ("asc", "desc"):
        for offset, limit in ((0, 3), (2, 5), (7, 3), (9, 6), (0, 20), (12, 3)):
            for exact in (True, False):
                f = {"order": order, "offset": offset, "limit": limit, "count_total": exact}
                got = S.query(df, f)
                assert [r.span_id for r in got.entries] == [r.span_id for r in S.page(df, f).collect()], f
                assert len(got.entries) == max(0, min(limit, 12 - offset)) and got.has_more == (12 > offset + limit)


def test_paging_by_the_last_row(spark):
    df = frame(spark, [(*span(i)[:5], None if i % 4 == 0 else 1000 * (i // 3), *span(i)[6:]) for i in range(23)])
    for order in ("asc", "desc"):
        f = {"order": order, "limit": 4}
        want = [r.span_id for r in S.page(df, {"order": order, "limit": 100}).collect()]
        got, last = [], None
        while page := (S.page(df, f) if last is None else S.page_after(df, f, last)).collect():
            got += [r.span_id for r in page]
            last = page[-1]
        assert got == want
