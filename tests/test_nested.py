import json
import random

import pytest

from conftest import rows
from spanloom.functions.jsonindex import ARRAY, OBJECT, STRING, index, unescape
from spanloom.operators.nested import TABLES, event_attributes, payload_attribute_paths, payload_table, snake, span_attributes, span_events, span_scope_links, span_scopes, span_values

SEEDS = ['{"a":[1,{"b":"x\\"y\\\\"}],"c":null,"d":{}}', '{"ü":"é\\u00e9\\n","n":-1.5e+3,"t":[true,false,[]]}', "[[],[[1,2],{}]]", '"s"', "7", "{}", "[]"]
BAD = ["", " ", "{", "}", "][", "{,}", "[1,]", '{"a"}', '{"a":}', '{"a":1 "b":2}', "[1 2]", "nul", "-", "01", "1.", '"\\x"', '"\\u12"', '"a', '"\t"', "{1:2}", '["a":1]', '{"a":"b":"c"}', "1 2", "{} {}", ":", ",", "NaN", "\\", '\\"', "[1]]", '{"a":1}}']


def valid(t):
    try:
        json.loads(t, parse_constant=lambda _: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


def rebuild(n, k):
    raw, vals, top = n.data.tobytes(), [], {}
    for i in range(len(n.text)):
        piece = raw[n.start[i] : n.end[i]]
        v = {} if n.kind[i] == OBJECT else [] if n.kind[i] == ARRAY else unescape(piece) if n.kind[i] == STRING else json.loads(piece)
        vals.append(v)
        p = n.parent[i]
        if p < 0:
            top[int(n.text[i])] = v
        elif n.kind[p] == OBJECT:
            vals[p][unescape(raw[n.key_start[i] : n.key_end[i]])] = v
        else:
            assert len(vals[p]) == n.pos[i]
            vals[p].append(v)
    return [top.get(i) for i in range(k)]


def test_index_against_json_with_mutations():
    rnd = random.Random(5)
    texts = SEEDS + BAD
    for t in SEEDS * 60:
        s = list(t)
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(s) + 1)
            s[i : i + rnd.randint(0, 1)] = rnd.choice(['{', '}', "[", "]", ",", ":", '"', "\\", "1", " ", "\n", "é", ""])
        texts.append("".join(s))
    n = index([t.encode() for t in texts] + [None])
    assert n.valid.tolist() == [valid(t) for t in texts] + [False]
    got = rebuild(n, len(texts))
    assert all(g == json.loads(t) for t, g in zip(texts, got) if valid(t))
    assert len(index([]).text) == 0


def _attr(k, **v):
    return {"key": k, "value": v}


BODY = {
    "resource_spans": {
        "resource": {"attributes": {"service.name": "x", "deployment": {"env": "prod", "ring": [1, None, {"q": True}]}, "none": None}},
        "instrumentationLibrarySpans": [
            None,
            {
                "instrumentationLibrary": {"name": "lib", "attributes": [_attr("tags", arrayValue={"values": [{"stringValue": "a"}, {"kvlist_value": {"values": _attr("in", intValue="3")}}]})]},
                "spans": [
                    {"spanId": "s1", "attributes": _attr("only", boolValue=False), "events": {"name": "e", "attributes": [_attr("d", double_value=1.5), {"key": "k"}, {"value": {"stringValue": "v"}}, _attr("n", stringValue=None)]}},
                    {"span_id": "s2", "attributes": [], "events": None},
                ],
            },
        ],
    }
}
PATHS = {
    ("resource", 0, -1, -1, -1, "service.name"), ("resource", 0, -1, -1, -1, "deployment/env"), ("resource", 0, -1, -1, -1, "deployment/ring/0"), ("resource", 0, -1, -1, -1, "deployment/ring/2/q"),
    ("scope", 0, 1, -1, -1, "tags/0"), ("scope", 0, 1, -1, -1, "tags/1/in"), ("span", 0, 1, 0, -1, "only"), ("event", 0, 1, 0, 0, "d"),
}


@pytest.mark.parametrize("indent", [None, 1])
def test_spellings_and_shapes(spark, indent):
    body = json.dumps(BODY, indent=indent)
    df = spark.createDataFrame([(1, body, "a"), (2, None, "b"), (3, body[:-3], "c"), (4, '{"data":"none"}', "d"), (5, "", "e"), (None, body, "f")], "payload_id long, body string, owner string")
    assert {tuple(r)[1:] for r in payload_attribute_paths(df).collect()} == PATHS
    assert {r[0] for r in payload_attribute_paths(df).collect()} == {1}
    spans = payload_table(df, "spans").collect()
    assert [(r.span_id, r.rs_no, r.ss_no, r.span_no) for r in spans] == [("s1", 0, 1, 0), ("s2", 0, 1, 1)]
    assert [r.name for r in payload_table(df, "scopes").collect()] == ["lib"]
    for t in TABLES:
        assert payload_table(df.limit(0), t).count() == 0


def test_long_text_and_deep_nesting(spark):
    deep = "x"
    v = {"stringValue": deep}
    for i in range(60):
        v = {"kvlistValue": {"values": [{"key": str(i), "value": v}]}}
    long = {"resourceSpans": [{"resource": {"attributes": [{"key": "k", "value": {"stringValue": "y" * 3_000_000}}, {"key": "deep", "value": v}]}}]}
    df = spark.createDataFrame([(1, json.dumps(long)), (2, json.dumps(long))], "payload_id long, body string")
    got = payload_table(df, "attributes").collect()
    assert len(got) == 4 and max(len(r.attr_value) for r in got) == 3_000_000 and max(r.attr_path.count("/") for r in got) == 60


def test_span_columns(spark):
    shape = "recv_no long, trace_id string, span_id string, attributes map<string,string>, resource map<string,string>, events array<struct<name string, ts long, attributes map<string,string>>>, instrumentation_scope struct<name string, version string>, owner int"
    df = spark.createDataFrame([(1, "T", "s", {"a": "1", "b": None}, {}, [("e", 5, {"x": "y"}), (None, None, None)], ("l", None), 1), (2, "t", None, None, None, None, None, 2)], shape)
    assert rows(span_attributes(df)) == [(1, "t", "s", "span", "a", "1"), (1, "t", "s", "span", "b", None)]
    assert rows(span_events(df)) == [(1, "t", "s", 0, "e", 5), (1, "t", "s", 1, None, None)]
    assert rows(event_attributes(df)) == [(1, "t", "s", 0, "x", "y")]
    assert rows(span_scopes(df)) == [("l", None, 1)]
    assert snake("resourceSpans") == "resource_spans" == snake("resource_spans")


def test_json_values_of_span_columns(spark):
    shape = "recv_no long, trace_id string, span_id string, attributes map<string,string>, resource map<string,string>, events array<struct<name string, ts long, attributes map<string,string>>>"
    headers = ' {"zone": "no\\u0072th", "accept": ["a/b", {"q": 0.5}], "sampled": true, "none": null, "rest": {}}'
    df = spark.createDataFrame([(1, " T", "S", {"h": headers, "bad": "[1, 2", "n": None, "no": "7"}, {"r": "[1,[]]", "t": "plain"}, [(None, None, None), ("e", 5, {"d": '{"codes": [0, 1]}', "x": "[]"})]), (2, "t", "u", None, {}, None)], shape)
    want = [
        ("span", -1, "h", "h/zone", "north", "string"), ("span", -1, "h", "h/accept/0", "a/b", "string"), ("span", -1, "h", "h/accept/1/q", "0.5", "double"), ("span", -1, "h", "h/sampled", "true", "bool"),
        ("span", -1, "h", "h/none", None, None), ("span", -1, "h", "h/rest", "{}", "object"), ("span", -1, "bad", "bad", "[1, 2", "string"), ("span", -1, "n", "n", None, None), ("span", -1, "no", "no", "7", "string"),
        ("resource", -1, "r", "r/0", "1", "int"), ("resource", -1, "r", "r/1", "[]", "array"), ("resource", -1, "t", "t", "plain", "string"),
        ("event", 1, "d", "d/codes/0", "0", "int"), ("event", 1, "d", "d/codes/1", "1", "int"), ("event", 1, "x", "x", "[]", "array"),
    ]
    assert rows(span_values(df)) == sorted(((1, "t", "s", *x) for x in want), key=repr)
    assert span_values(df.limit(0)).collect() == []


def test_scope_of_each_receipt(spark):
    df = spark.createDataFrame([(1, " T", "S", ("l", None)), (2, "t", "s", ("l", None)), (3, "t", "u", None), (4, None, "v", (None, None)), (5, "t", "w", ("m", "1"))], "recv_no long, trace_id string, span_id string, instrumentation_scope struct<name string, version string>")
    links = span_scope_links(df)
    assert rows(links) == [(1, "t", "s", "l", None), (2, "t", "s", "l", None), (4, None, "v", None, None), (5, "t", "w", "m", "1")]
    assert rows(links.groupBy("scope_name", "scope_version").count()) == rows(span_scopes(df))
