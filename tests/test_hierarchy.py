import random

import numpy as np
import pytest

from conftest import rows
from spanloom.operators.hierarchy import _path_slices, hierarchy, members, peel, span_hierarchy
from spanloom.runtime import table

SHAPE = "trace_id string, span_id string, parent_id string, start_time long"


def brute(nodes):
    par = {(t, s): (t, p) if p is not None and (t, p) in nodes else None for (t, s), p in nodes.items()}
    out, below = {}, {k: set() for k in par}
    for k in par:
        seen, cur = [k], k
        while par[cur] is not None and par[cur] not in seen:
            cur = par[cur]
            seen.append(cur)
        for x in seen:
            if x != k:
                below[x].add(k)
        if par[cur] is None:
            out[k] = (seen[-1][1], len(seen) - 1, [x[1] for x in reversed(seen)])
        else:
            out[k] = ("", -1 if par[cur] == k else -2, [])
    return sorted((t, s, r, d, len(below[t, s]), p) for (t, s), (r, d, p) in out.items())


def forest(seed, n=400, traces=4):
    rnd = random.Random(seed)
    nodes = {}
    for t in range(traces):
        ids = [f"{i:04x}" for i in range(n if t == 0 else n // 10)]
        for i, s in enumerate(ids):
            p = None if i == 0 else rnd.choice([ids[i - 1], ids[rnd.randrange(i)], ids[rnd.randrange(i)]])
            x = rnd.random()
            p = None if x < 0.02 else "ffff" if x < 0.04 else rnd.choice(ids) if x < 0.06 else s if x < 0.065 else p
            nodes[f"t{t}", s] = p
    return nodes


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("size", [100_000, 60])
def test_forest_with_circles_whole_and_in_blocks(spark, seed, size):
    nodes = forest(seed)
    df = spark.createDataFrame([(t, s, p, i) for i, ((t, s), p) in enumerate(nodes.items())], SHAPE)
    got = hierarchy(df, path=True, group_rows=size, chunk_rows=50)
    assert sorted((r[0], r[1], r[2], r[3], r[4], list(r[5])) for r in got.collect()) == brute(nodes)


def test_long_chain_and_star_in_blocks(spark):
    nodes = {("c", f"{i:04d}"): f"{i - 1:04d}" if i else None for i in range(300)}
    nodes |= {("s", f"{i:04d}"): "0000" if i else None for i in range(300)}
    df = spark.createDataFrame([(t, s, p, (i * 7919) % 600) for i, ((t, s), p) in enumerate(nodes.items())], SHAPE)
    assert [r[:5] for r in brute(nodes)] == rows(hierarchy(df, group_rows=40))


def test_empty_and_null_rows(spark):
    df = spark.createDataFrame([(None, "a", None, 1), ("t", None, None, 1)], SHAPE)
    assert hierarchy(df).collect() == []
    assert hierarchy(df.limit(0)).collect() == []


def test_dirty_ids_repeats_and_extra_columns(spark):
    shape = "trace_id string, span_id string, parent_span_id string, start_time long, recv_no long, depth string, root_span_id int"
    x = [(" T1", "A ", "", 1, 1, "x", 3), ("t1", "a", "0000", 1, 2, "y", 4), ("T1", "b", " A", 2, 3, None, None), ("t1", "c", "b", 3, 4, None, None)]
    got = rows(span_hierarchy(spark.createDataFrame(x, shape)))
    assert got == [("t1", "a", "a", 0, 2), ("t1", "b", "a", 1, 1), ("t1", "c", "a", 2, 0)]


def places(nodes):
    """Places and ranges by walking the trees."""
    full = {(t, s): (r, d, n, p) for t, s, r, d, n, p in brute(nodes)}
    kids, out = {}, {}
    for (t, s), p in nodes.items():
        kids.setdefault((t, p), []).append(s)
    for t in {t for t, _ in nodes}:
        mine = [s for x, s in nodes if x == t]
        at = 0

        def walk(tops, at, t=t):
            stack = sorted(tops, reverse=True)
            while stack:
                s = stack.pop()
                out[t, s] = at
                at += 1
                stack += sorted((k for k in kids.get((t, s), ()) if full[t, k][1] != -1), reverse=True)
            return at

        at = walk([s for s in mine if full[t, s][1] == 0], at)
        loose, rings = {s for s in mine if full[t, s][1] == -1}, []
        while loose:
            ring, s = [], min(loose)
            while s in loose:
                loose.discard(s)
                ring.append(s)
                s = nodes[t, s]
            rings.append(sorted(ring))
        for ring in rings:
            first = at
            for s in ring:
                out[t, s] = at
                at += 1
            at = walk([k for s in ring for k in kids[t, s] if full[t, k][1] == -2], at)
            for s in ring:
                out[t, s] = (out[t, s], first, first + full[t, s][2])
    return sorted((t, s, *(v if isinstance(v, tuple) else (v, v + 1, v + full[t, s][2]))) for (t, s), v in out.items())


@pytest.mark.parametrize("size", [100_000, 60])
def test_ranges_of_descendants(spark, size):
    nodes = forest(3)
    df = spark.createDataFrame([(t, s, p, i) for i, ((t, s), p) in enumerate(nodes.items())], SHAPE)
    got = hierarchy(df, ranges=True, group_rows=size, chunk_rows=50)
    assert rows(got.select("trace_id", "span_id", "pos", "first_pos", "last_pos")) == places(nodes)


def test_members_of_every_node(spark, data):
    tree = span_hierarchy(table(spark, data, "spans"), ranges=True)
    n = {(r[0], r[1]): r[4] for r in tree.collect() if r[4]}
    got = {(r[0], r[1]): r[2] for r in members(tree, tree).groupBy("trace_id", "ancestor_id").count().collect()}
    assert got == n


def test_chain_of_200_000_and_a_circle_in_a_large_group(spark):
    n = 200_000
    x = spark.range(n).selectExpr("'c' trace_id", "lpad(hex(id), 16, '0') span_id", "case when id > 0 then lpad(hex(id - 1), 16, '0') end parent_id", "id start_time")
    ring = spark.range(6).selectExpr("'c' trace_id", "concat('ring', id) span_id", "concat('ring', (id + 1) % 6) parent_id", "id start_time")
    tail = spark.createDataFrame([("c", "tail", "ring3", 5)], SHAPE)
    every = x.unionByName(ring).unionByName(tail)
    for rows_ in (500_000, 30_000):
        got = hierarchy(every, ranges=True, group_rows=rows_)
        assert [tuple(r) for r in got.where("depth < 0 or depth >= 199999").orderBy("span_id").select("span_id", "depth", "n_descendants", "pos", "first_pos", "last_pos").collect()] == [
            (f"{n - 1:016X}", n - 1, 0, n - 1, n, n - 1),
            *((f"ring{i}", -1, 6, n + i, n, n + 6) for i in range(6)),
            ("tail", -2, 0, n + 6, n + 7, n + 6),
        ]
        assert got.where("depth >= 0 and (n_descendants <> 199999 - depth or pos <> depth or last_pos <> 199999)").count() == 0


def test_paths_of_a_long_chain(spark):
    n = 17_500
    x = spark.range(n).selectExpr("'c' trace_id", "lpad(hex(id), 16, '0') span_id", "case when id > 0 then lpad(hex(id - 1), 16, '0') end parent_id", "id start_time")
    got = hierarchy(x, path=True).selectExpr("sum(size(path)) k", "max(size(path)) m", "count_if(path[0] = '0000000000000000' and path[size(path) - 1] = span_id) ok").first()
    assert tuple(got) == (n * (n + 1) // 2, n, n)


def test_path_slices_are_bounded():
    par = np.arange(-1, 99)
    got = list(_path_slices(par, np.arange(100), np.ones(100, bool), cells=300))
    assert [a for a, *_ in got] == [0, *(b for _, b, *_ in got[:-1])] and got[-1][1] == 100
    assert all(len(flat) <= 300 for _, _, flat, _ in got)
    assert [x.tolist() for a, b, flat, off in got for x in np.split(flat, off[1:-1])] == [list(range(i + 1)) for i in range(100)]


def test_peel_counts():
    size, order, done = peel(np.array([-1, 0, 0, 1, 5, 4]))
    assert size[:4].tolist() == [3, 1, 0, 0] and done.tolist() == [True] * 4 + [False] * 2 and len(order) == 3
