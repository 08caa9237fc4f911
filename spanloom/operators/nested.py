"""Deeply nested records to related flat tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.ids import norm_id, norm_parent
from spanloom.functions.jsonindex import ARRAY, OBJECT, OTHER, STRING, Nodes, Strings, index, slices, unescape

#: Bytes of text that are indexed at once; a longer text is indexed alone.
INDEX_BYTES = 2_000_000

#: Fixed values of the format: names of members in their snake_case spelling.
#: The older spelling of a member stands for the newer one.
MEMBERS = ["resource_spans", "resource", "scope_spans", "scope", "spans", "events", "attributes", "key", "value", "values", "array_value", "kvlist_value", "string_value", "int_value", "double_value", "bool_value", "bytes_value"]
OLDER = {"instrumentation_library_spans": "scope_spans", "instrumentation_library": "scope"}
SCALARS = {"string_value": "string", "int_value": "int", "double_value": "double", "bool_value": "bool", "bytes_value": "bytes"}

_KINDS = pa.array(["string", "bool", "double", "int"])
_CODE = {m: i for i, m in enumerate(MEMBERS)}
_UPPER = re.compile("(?<=[a-z0-9])([A-Z])")
NUMBERS = ["rs_no", "ss_no", "span_no", "event_no"]


def snake(name: str) -> str:
    return _UPPER.sub(lambda m: "_" + m[1].lower(), name)


def _cat(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _below(path: pa.Array, key: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(path, key, "/")


class _Doc:
    """Nodes of several texts with codes of their keys; owners found level by level."""

    def __init__(self, nodes: Nodes):
        self.n = nodes
        self.strings = Strings(nodes.data)
        k = len(nodes.text)
        has = np.flatnonzero(nodes.key_start >= 0)
        spelt = slices(nodes.data, nodes.key_start[has], nodes.key_end[has]).dictionary_encode()
        # each spelling of a key is looked at once
        names = [unescape(x) for x in spelt.dictionary.to_pylist()]
        self.snakes = [snake(x) for x in names]
        self.names = pa.array(names, pa.string())
        codes = np.array([_CODE.get(OLDER.get(w, w), -1) for w in self.snakes] or [-1])
        self.key, self.code = np.full(k, -1), np.full(k, -1)
        self.key[has] = spelt.indices.to_numpy()
        self.code[has] = codes[self.key[has]]
        self.null = (nodes.kind == OTHER) & (nodes.data[nodes.start] == 110)
        self._fraction = np.concatenate([[0], np.cumsum(np.isin(nodes.data, np.frombuffer(b".eE", np.uint8)))])
        # children of a node, as slices of one order
        self.order = np.argsort(nodes.parent, kind="stable")
        self.sorted_parent = nodes.parent[self.order]

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(child, position in `of` of its parent)"""
        lo, hi = np.searchsorted(self.sorted_parent, of), np.searchsorted(self.sorted_parent, of, "right")
        k = hi - lo
        src = np.repeat(np.arange(len(of)), k)
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k)
        return self.order[at], src

    def member(self, of: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        c, src = self.children(of)
        hit = self.code[c] == _CODE[name]
        return c[hit], src[hit]

    def items(self, c: np.ndarray, src: np.ndarray, objects: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elements of arrays; what isn't an array is its only element. (element, source, number)"""
        arr = self.n.kind[c] == ARRAY
        e, s = self.children(c[arr])
        el = np.concatenate([c[~arr], e])
        so = np.concatenate([src[~arr], src[arr][s]])
        no = np.concatenate([np.zeros((~arr).sum(), np.int64), self.n.pos[e]])
        if objects:
            keep = self.n.kind[el] == OBJECT
            el, so, no = el[keep], so[keep], no[keep]
        return el, so, no

    def texts(self, nodes: np.ndarray) -> pa.Array:
        return self.strings.take(self.n.start[nodes], self.n.end[nodes])

    def steps(self, nodes: np.ndarray) -> pa.Array:
        """Key of each node, in arrays its position."""
        key = self.key[nodes]
        named = self.names.take(pa.array(key, mask=key < 0))
        return pc.coalesce(named, pa.array(self.n.pos[nodes]).cast(pa.string()))

    def scalar_kinds(self, nodes: np.ndarray) -> pa.Array:
        n = self.n
        start, end = n.start[nodes], n.end[nodes]
        first = n.data[np.minimum(start, len(n.data) - 1)] if len(n.data) else start
        kind = np.select([n.kind[nodes] == STRING, (first == 116) | (first == 102), self._fraction[end] > self._fraction[start]], [0, 1, 2], 3)
        return _KINDS.take(pa.array(kind))

    def owners(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """By kind of owner: nodes, and their text and four numbers."""
        n = self.n
        top = np.flatnonzero((n.parent < 0) & (n.kind == OBJECT))

        def below(nodes: np.ndarray, nums: np.ndarray, name: str, col: int) -> tuple[np.ndarray, np.ndarray]:
            el, src, no = self.items(*self.member(nodes, name))
            got = nums[src].copy()
            got[:, col] = no
            return el, got

        def single(nodes: np.ndarray, nums: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
            el, src, no = self.items(*self.member(nodes, name))
            return el, nums[src]

        base = np.full((len(top), 5), -1)
        base[:, 0] = n.text[top]
        rs = below(top, base, "resource_spans", 1)
        ss = below(*rs, "scope_spans", 2)
        sp = below(*ss, "spans", 3)
        ev = below(*sp, "events", 4)
        return {"resource": single(*rs, "resource"), "scope": single(*ss, "scope"), "span": sp, "event": ev}

    def entries(self, c: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Values of key/value entries: (value node, source, key)"""
        el, so, _ = self.items(c, src)
        ks, a = self.member(el, "key")
        a, ks = a[self.n.kind[ks] == STRING], ks[self.n.kind[ks] == STRING]
        key_of = np.full(len(el), -1)
        key_of[a] = ks
        v, b = self.member(el, "value")
        keep = (key_of[b] >= 0) & ~self.null[v]
        v, b = v[keep], b[keep]
        return v, so[b], self.texts(key_of[b])

    def boxed(self, typed: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """What the values of list-like typed values hold, given as such or in `values`."""
        box, a = self.member(typed, name)
        is_obj, direct = self.n.kind[box] == OBJECT, self.n.kind[box] == ARRAY
        values, b = self.member(box[is_obj], "values")
        return np.concatenate([values, box[direct]]), np.concatenate([a[is_obj][b], a[direct]])

    def attributes(self, nodes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
        """Scalar attribute values of the owners: (position in nodes, path, value, type)"""
        n = self.n
        c, src = self.member(nodes, "attributes")
        obj = n.kind[c] == OBJECT
        # an object that is itself an entry is a list's only element
        if obj.any():
            _, k = self.member(c, "key")
            v, w = self.member(c, "value")
            w = w[n.kind[v] == OBJECT]
            entry = np.zeros(len(c), bool)
            entry[np.intersect1d(k, w)] = True
            obj &= ~entry
        lists = (n.kind[c] == ARRAY) | ((n.kind[c] == OBJECT) & ~obj)
        typed, t_src, t_path = self.entries(c[lists], src[lists])
        plain, p = self.children(c[obj])
        p_src, p_path = src[obj][p], self.steps(plain)
        out: tuple[list, list, list, list] = ([], [], [], [])

        def emit(v: np.ndarray, so: np.ndarray, path: pa.Array, kinds: pa.Array) -> None:
            if len(v):
                for o, x in zip(out, (so, path, self.texts(v), kinds), strict=True):
                    o.append(x)

        while len(typed) or len(plain):
            # what isn't an object in place of a typed value is taken as it is
            as_is = n.kind[typed] != OBJECT
            if as_is.any():
                w = np.flatnonzero(as_is)
                plain, p_src, p_path = np.concatenate([plain, typed[w]]), np.concatenate([p_src, t_src[w]]), _cat([p_path, t_path.take(pa.array(w))])
                w = np.flatnonzero(~as_is)
                typed, t_src, t_path = typed[w], t_src[w], t_path.take(pa.array(w))
            for name, kind in SCALARS.items():
                v, a = self.member(typed, name)
                ok = (n.kind[v] >= STRING) & ~self.null[v]
                v, a = v[ok], a[ok]
                emit(v, t_src[a], t_path.take(pa.array(a)), pa.repeat(kind, len(v)))
            kv, s, keys = self.entries(*self.boxed(typed, "kvlist_value"))
            el, e, no = self.items(*self.boxed(typed, "array_value"), objects=False)
            keep = ~self.null[el]
            el, e, no = el[keep], e[keep], no[keep]
            deeper = _cat([_below(t_path.take(pa.array(s)), keys), _below(t_path.take(pa.array(e)), pa.array(no).cast(pa.string()))])
            # plain values
            w = np.flatnonzero((n.kind[plain] >= STRING) & ~self.null[plain])
            emit(plain[w], p_src[w], p_path.take(pa.array(w)), self.scalar_kinds(plain[w]))
            box = np.flatnonzero(n.kind[plain] <= ARRAY)
            ch, q = self.children(plain[box])
            q = box[q]
            p_path, p_src, plain = _below(p_path.take(pa.array(q)), self.steps(ch)), p_src[q], ch
            typed, t_src, t_path = np.concatenate([kv, el]), np.concatenate([t_src[s], t_src[e]]), deeper
        return np.concatenate(out[0]) if out[0] else np.empty(0, np.int64), *map(_cat, out[1:])

    def fields(self, nodes: np.ndarray, names: list[str]) -> list[pa.Array]:
        """Scalar members of the owners by their snake_case names (of repeated ones the
        last); a dot steps into an object."""
        ch, src = self.children(nodes)
        cols = []
        for name in names:
            c, s, *path = ch, src, *name.split(".")
            for k, part in enumerate(path):
                if k:
                    c, up = self.children(c)
                    s = s[up]
                hit = self._called(c, part) & (self.n.kind[c] == OBJECT if k < len(path) - 1 else (self.n.kind[c] >= STRING) & ~self.null[c])
                c, s = c[hit], s[hit]
            pick = np.full(len(nodes), -1)
            pick[s] = c
            got = np.flatnonzero(pick >= 0)
            place = np.full(len(nodes), -1)
            place[got] = np.arange(len(got))
            cols.append(self.texts(pick[got]).take(pa.array(place, mask=place < 0)))
        return cols

    def _called(self, nodes: np.ndarray, name: str) -> np.ndarray:
        return np.isin(self.key[nodes], [i for i, w in enumerate(self.snakes) if w == name])


def _slices(ids: pa.Array, body: pa.Array) -> Iterator[tuple[list, list[bytes | None]]]:
    got_i: list = []
    got_b: list[bytes | None] = []
    size = 0
    for i, b in zip(ids.to_pylist(), body.cast(pa.binary()).to_pylist(), strict=True):
        if got_b and size + len(b or b"") > INDEX_BYTES:
            yield got_i, got_b
            got_i, got_b, size = [], [], 0
        got_i.append(i)
        got_b.append(b)
        size += len(b or b"")
    if got_b:
        yield got_i, got_b


SPAN_FIELDS = ["trace_id", "span_id", "parent_span_id", "name", "kind", "start_time_unix_nano", "end_time_unix_nano", "status.code", "status.message"]
TABLES = {
    "attributes": [],
    "resources": [],
    "scopes": ["name", "version"],
    "spans": SPAN_FIELDS,
    "events": ["name", "time_unix_nano"],
}
_OWNER = {"resources": "resource", "scopes": "scope", "spans": "span", "events": "event"}


def payload_table(payloads: DataFrame, table: str, id_col: str = "payload_id", body_col: str = "body") -> DataFrame:
    """One of the flat tables of nested trace requests.

    attributes: payload_id, owner, rs_no, ss_no, span_no, event_no, attr_path,
    attr_value, attr_type. resources, scopes, spans, events: payload_id, the
    numbers down to their level (-1 below), and their scalar members. The
    numbers are the links from a row to its parent's row.

    Bodies that are null, no valid JSON or no trace request give no rows; so do
    missing, null and empty parts. Both spellings of members, the older member
    names and an object in place of a list of one object are understood.
    Repeated payloads are told apart by payload_id only. Other columns of
    payloads, whatever their names, aren't read.
    """
    names = TABLES[table]
    long = ", ".join(f"{x} bigint" for x in NUMBERS)
    if table == "attributes":
        shape = f"payload_id bigint, owner string, {long}, attr_path string, attr_value string, attr_type string"
    else:
        shape = f"payload_id bigint, {long}" + "".join(f", {x.replace('.', '_')} string" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bodies in _slices(batch.column(0), batch.column(1)):
                doc = _Doc(index(bodies))
                number = np.array(ids, np.int64)
                owners = doc.owners()
                if table == "attributes":
                    for owner, (nodes, nums) in owners.items():
                        src, path, value, kind = doc.attributes(nodes)
                        got = nums[src]
                        cols = [pa.array(number[got[:, 0]]), pa.repeat(owner, len(src)), *(pa.array(got[:, i]) for i in range(1, 5)), path, value, kind]
                        yield pa.RecordBatch.from_arrays(cols, ["payload_id", "owner", *NUMBERS, "attr_path", "attr_value", "attr_type"])
                else:
                    nodes, nums = owners[_OWNER[table]]
                    cols = [pa.array(number[nums[:, 0]]), *(pa.array(nums[:, i]) for i in range(1, 5)), *doc.fields(nodes, names)]
                    yield pa.RecordBatch.from_arrays(cols, ["payload_id", *NUMBERS, *(x.replace(".", "_") for x in names)])

    return payloads.select(F.col(id_col).cast("long").alias("payload_id"), F.col(body_col).alias("body")).where("payload_id is not null").mapInArrow(run, shape)


def payload_attribute_paths(payloads: DataFrame) -> DataFrame:
    """Distinct places of scalar attribute values in the payloads."""
    return payload_table(payloads, "attributes").select("payload_id", "owner", *NUMBERS, "attr_path").distinct()


# --- nested columns of the spans table -----------------------------------------


def _key(spans: DataFrame) -> list:
    return ["recv_no", norm_id("trace_id").alias("trace_id"), norm_id("span_id").alias("span_id")]


def span_attributes(spans: DataFrame) -> DataFrame:
    """attributes and resource as rows: recv_no, trace_id, span_id, owner, attr_key,
    attr_value. Null and empty maps give no rows; a null value is a row."""
    a = spans.select(*_key(spans), F.lit("span").alias("owner"), F.explode("attributes").alias("attr_key", "attr_value"))
    r = spans.select(*_key(spans), F.lit("resource").alias("owner"), F.explode("resource").alias("attr_key", "attr_value"))
    return a.unionByName(r)


def span_events(spans: DataFrame) -> DataFrame:
    """events as rows with their place in the list (event_no); no list, no rows."""
    e = spans.select(*_key(spans), F.posexplode("events").alias("event_no", "e"))
    return e.select("recv_no", "trace_id", "span_id", F.col("event_no").cast("long").alias("event_no"), F.col("e.name").alias("event_name"), F.col("e.ts").alias("event_ts"))


def event_attributes(spans: DataFrame) -> DataFrame:
    e = spans.select(*_key(spans), F.posexplode("events").alias("event_no", "e"))
    return e.select("recv_no", "trace_id", "span_id", F.col("event_no").cast("long").alias("event_no"), F.explode("e.attributes").alias("attr_key", "attr_value"))


#: What a value that can be a JSON object or array begins with.
_BOX = r"^[ \t\r\n]*[\[{]"
_VALUE_COLS = ["recv_no", "trace_id", "span_id", "owner", "event_no", "attr_key"]


def _leaves(doc: _Doc, keys: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """(number of the text, path, value, type) of all scalars, nulls and empty
    containers of the valid texts; the path begins with the text's key. Level by level."""
    n = doc.n
    out: tuple[list, list, list, list] = ([], [], [], [])
    nodes = np.flatnonzero(n.parent < 0)
    path = keys.take(pa.array(n.text[nodes]))
    while len(nodes):
        ch, up = doc.children(nodes)
        box = n.kind[nodes] <= ARRAY
        full = np.zeros(len(nodes), bool)
        full[up] = True
        for w, value, kind in (
            (~box & ~doc.null[nodes], None, None),
            (~box & doc.null[nodes], pa.scalar(None, pa.string()), pa.scalar(None, pa.string())),
            (box & ~full & (n.kind[nodes] == OBJECT), "{}", "object"),
            (box & ~full & (n.kind[nodes] == ARRAY), "[]", "array"),
        ):
            at = np.flatnonzero(w)
            if len(at):
                some = nodes[at]
                out[0].append(n.text[some])
                out[1].append(path.take(pa.array(at)))
                out[2].append(doc.texts(some) if value is None else pa.repeat(value, len(at)))
                out[3].append(doc.scalar_kinds(some) if kind is None else pa.repeat(kind, len(at)))
        path = _below(path.take(pa.array(up)), doc.steps(ch))
        nodes = ch
    return np.concatenate(out[0]) if out[0] else np.empty(0, np.int64), *map(_cat, out[1:])


def _json_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in _slices(pa.array(range(batch.num_rows)), batch.column("attr_value")):
            part = batch.slice(at[0], len(at))
            nodes = index(texts)
            src, *new = _leaves(_Doc(nodes), part.column("attr_key"))
            no = np.flatnonzero(~nodes.valid)
            rest = [part.column("attr_key").take(pa.array(no)), part.column("attr_value").take(pa.array(no)), pa.repeat("string", len(no))]
            cols = [part.column(c).take(pa.array(np.concatenate([src, no]))) for c in _VALUE_COLS]
            yield pa.RecordBatch.from_arrays([*cols, *(_cat([x, y]) for x, y in zip(new, rest, strict=True))], [*_VALUE_COLS, "attr_path", "attr_value", "attr_type"])


def span_values(spans: DataFrame) -> DataFrame:
    """The values of attributes, resource and event attributes with JSON taken apart:
    recv_no, trace_id, span_id, owner (span, resource, event), event_no (-1 but for
    events), attr_key, attr_path, attr_value, attr_type.

    A value that is a JSON object or array gives a row for each scalar inside, at any
    depth, with the path attr_key/member/position. So that nothing is lost, a null
    inside is a row without value and type, and an empty object or array one of type
    object or array. Any other text, and what isn't valid JSON, is one row as it is,
    with attr_path = attr_key; so is a null value.
    """
    a = span_attributes(spans).withColumn("event_no", F.lit(-1).cast("long"))
    e = event_attributes(spans).withColumn("owner", F.lit("event"))
    every = a.unionByName(e).select(*_VALUE_COLS, "attr_value")
    box = F.coalesce(F.col("attr_value").rlike(_BOX), F.lit(False))
    kind = F.when(F.col("attr_value").isNotNull(), "string")
    text = every.where(~box).select(*_VALUE_COLS, F.col("attr_key").alias("attr_path"), "attr_value", kind.alias("attr_type"))
    shape = "recv_no bigint, trace_id string, span_id string, owner string, event_no bigint, attr_key string, attr_path string, attr_value string, attr_type string"
    return text.unionByName(every.where(box).mapInArrow(_json_values, shape))


def span_scopes(spans: DataFrame) -> DataFrame:
    """Each scope once with the number of spans' receipts that name it."""
    s = spans.where("instrumentation_scope is not null").select(F.col("instrumentation_scope.name").alias("scope_name"), F.col("instrumentation_scope.version").alias("scope_version"))
    return s.groupBy("scope_name", "scope_version").agg(F.count(F.lit(1)).alias("n_receipts"))


def span_scope_links(spans: DataFrame) -> DataFrame:
    """The scope of each receipt that has one; name and version, of which either may
    be null, are the key of span_scopes."""
    s = F.col("instrumentation_scope")
    return spans.where(s.isNotNull()).select(*_key(spans), s["name"].alias("scope_name"), s["version"].alias("scope_version"))


def span_core(spans: DataFrame) -> DataFrame:
    """The flat columns of each receipt with its links."""
    return spans.select(*_key(spans), norm_parent("parent_span_id").alias("parent_id"), "name", "start_time", "end_time")
