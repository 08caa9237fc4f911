"""Parent-child links to full hierarchies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.orphans import distinct_spans
from spanloom.runtime import cut

#: Nodes of one tree group that one task may hold; larger groups are peeled in
#: blocks of this size and joined up afterwards.
GROUP_ROWS = 250_000
#: Nodes of several small groups that are peeled together.
CHUNK_ROWS = 250_000
#: Large groups up to this number are told to all tasks; beyond it they are joined.
HOT_LIST = 10_000
#: Identifiers in the paths of one batch of rows; one longer path is a batch alone.
PATH_CELLS = 2_000_000


# --- peeling in one block ---------------------------------------------------


def peel(par: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Removes leaves round by round. par: index of the parent or -1; held: True
    for nodes with a child elsewhere. Returns (descendants sent up so far, the
    rounds, which nodes were peeled)."""
    n = len(par)
    size = np.zeros(n, np.int64)
    left = np.bincount(par[par >= 0], minlength=n)
    if held is not None:
        left = left + held
    done = np.zeros(n, bool)
    rounds = []
    front = np.flatnonzero(left == 0)
    while len(front):
        rounds.append(front)
        done[front] = True
        up = front[par[front] >= 0]
        p = par[up]
        np.add.at(size, p, size[up] + 1)
        np.subtract.at(left, p, 1)
        p = np.unique(p)
        front = p[left[p] == 0]
    return size, rounds, done


def descend(par: np.ndarray, rounds: list[np.ndarray], done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reverse peel order: for each peeled node the topmost peeled ancestor (or
    itself) and the number of steps to it; -1 for nodes that weren't peeled."""
    top = np.where(done, np.arange(len(par)), -1)
    steps = np.zeros(len(par), np.int64)
    for front in reversed(rounds):
        p = par[front]
        under = (p >= 0) & done[p]
        f, p = front[under], p[under]
        top[f] = top[p]
        steps[f] = steps[p] + 1
    return top, steps


def _path_slices(par: np.ndarray, steps: np.ndarray, take: np.ndarray, cells: int = PATH_CELLS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices a..b of the nodes whose paths have about as many entries as cells, with
    the nodes from the top down to each one (none if not in take) and their offsets."""
    length = np.where(take, steps + 1, 0)
    ends = np.cumsum(length)
    a = 0
    while a < len(par):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + cells, "right")))
        off = np.concatenate([[0], np.cumsum(length[a:b])])
        flat = np.empty(off[-1], np.int64)
        cur = a + np.flatnonzero(take[a:b])
        at = off[cur - a] + steps[cur]
        left = steps[cur]
        while len(cur):
            flat[at] = cur
            go = left > 0
            cur, at, left = par[cur[go]], at[go] - 1, left[go] - 1
        yield a, b, flat, off
        a = b


def _with_paths(rows: pa.RecordBatch, span: pa.Array, par: np.ndarray, steps: np.ndarray, take: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a, b, flat, off in _path_slices(par, steps, take):
        path = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), span.take(pa.array(flat)))
        yield pa.RecordBatch.from_arrays([*rows.slice(a, b - a).columns, path], [*rows.schema.names, "path"])


def _codes(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (group, node) and the index of each row's parent in the block, or -1."""
    g, s, p = (t.column(i).combine_chunks() for i in range(3))
    gi = g.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = pa.concat_arrays([s, p]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    both = np.where(np.isnan(both), -1, both).astype(np.int64) if both.dtype.kind == "f" else both.astype(np.int64)
    m = int(both.max(initial=0)) + 1
    n = len(s)
    me, up = gi * m + both[:n], np.where(both[n:] >= 0, gi * m + both[n:], -1)
    order = np.argsort(me, kind="stable")
    at = np.searchsorted(me[order], up)
    at = np.minimum(at, n - 1)
    par = np.where((up >= 0) & (me[order[at]] == up), order[at], -1) if n else np.empty(0, np.int64)
    return gi, par


def cycle_totals(par: np.ndarray, loose: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes on circles (loose): the other nodes on and below their circle,
    and the place in loose of the circle's first node."""
    number = np.full(len(par), -1)
    number[loose] = np.arange(len(loose))
    ahead, label = number[par[loose]], np.arange(len(loose))
    for _ in range(int(np.ceil(np.log2(max(2, len(loose))))) + 1):
        label = np.minimum(label, label[ahead])
        ahead = ahead[ahead]
    total = np.bincount(label, weights=size[loose].astype(float) + 1, minlength=len(loose)).astype(np.int64)
    return total[label] - 1, label


def _starts(order: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For rows in an order that keeps groups together: the weight before each in its group."""
    w, g = weight[order], group[order]
    before = np.cumsum(w) - w
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    return before - before[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))] if len(g) else before


def _numbered(gi: np.ndarray, par: np.ndarray, rank: np.ndarray, size: np.ndarray, rounds: list[np.ndarray], done: np.ndarray, top: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, first, last): the place of each node in its group's order of visit and the
    range of places of its descendants. Parents come before their children, brothers
    by identifier; trees first, then circle by circle its nodes and what hangs below."""
    n = len(par)
    is_top = ~done | (par < 0) | ~done[par]
    hang = np.where(done, par[np.maximum(top, 0)], np.arange(n))
    circle = np.where(hang >= 0, label[np.maximum(hang, 0)], -1)  # -1 in trees
    pos = np.zeros(n, np.int64)
    tops = np.flatnonzero(is_top)
    order = np.lexsort((rank[tops], done[tops], circle[tops], gi[tops]))
    pos[tops[order]] = _starts(order, gi[tops], np.where(done[tops], size[tops] + 1, 1))
    kids = np.flatnonzero(~is_top)
    order = np.lexsort((rank[kids], par[kids]))
    brother = np.zeros(n, np.int64)
    brother[kids[order]] = _starts(order, par[kids], size[kids] + 1)
    for front in reversed(rounds):
        f = front[~is_top[front]]
        pos[f] = pos[par[f]] + 1 + brother[f]
    first = pos + 1
    loose = np.flatnonzero(~done)
    if len(loose):
        low = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, label[loose], pos[loose])
        first[loose] = low[label[loose]]
    return pos, first, np.where(done, pos + size, first + size)


def _whole(t: pa.Table, path: bool, ranges: bool) -> Iterator[pa.RecordBatch]:
    """Solves a table of whole groups."""
    gi, par = _codes(t)
    span = t.column(1).combine_chunks()
    size, rounds, done = peel(par)
    top, steps = descend(par, rounds, done)
    loose = np.flatnonzero(~done)
    rank = np.empty(len(par), np.int64)
    if ranges or len(loose):
        rank[pc.sort_indices(span).to_numpy()] = np.arange(len(par))
    label = np.full(len(par), -1)
    if len(loose):
        loose = loose[np.argsort(rank[loose])]
        # circle nodes got from their circle neighbours nothing: only peeled nodes send
        size[loose], label[loose] = cycle_totals(par, loose, size)
    over = par[np.maximum(top, 0)]
    below = done & (over >= 0)  # the topmost peeled ancestor hangs on a circle
    depth = np.where(~done, -1, np.where(below, -2, steps))
    root = pc.if_else(pa.array(depth >= 0), span.take(pa.array(np.maximum(top, 0))), pa.scalar("", span.type))
    cols = [t.column(0).combine_chunks(), span, root, pa.array(depth), pa.array(size)]
    names = ["trace_id", "span_id", "root_span_id", "depth", "n_descendants"]
    if ranges:
        cols += map(pa.array, _numbered(gi, par, rank, size, rounds, done, top, label))
        names += RANGES
    rows = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names)
    if path:
        yield from _with_paths(rows, span, par, steps, depth >= 0)
    else:
        yield rows


def _group_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        if n >= rows:
            key = held[-1].column(0)[held[-1].num_rows - 1]
            same = pc.sum(pc.equal(b.column(0), key)).as_py() or 0
            if same < b.num_rows:
                yield pa.Table.from_batches([*held, b.slice(0, same)] if same else held)
                held, n = [], 0
                b = b.slice(same)
        held.append(b)
        n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


RANGES = ["pos", "first_pos", "last_pos"]


def _out(path: bool, ranges: bool) -> str:
    return "trace_id string, span_id string, root_span_id string, depth bigint, n_descendants bigint" + "".join(f", {c} bigint" for c in RANGES) * ranges + ", path array<string>" * path


# --- large groups -------------------------------------------------------------


def _large(nodes: DataFrame, path: bool, ranges: bool, block_rows: int) -> DataFrame:
    """Groups that no task may hold whole.

    Every block of block_rows nodes (in order of start_time, so that most
    subtrees lie in one block) peels the nodes whose children are all inside
    it. A node that wasn't peeled has a parent that wasn't peeled either, so the
    rest is a smaller forest; on it, steps up double each round, with
    subtree sizes added along. Each peeled node hangs on the rest by one node.
    Paths are made last, for nodes that are known to lie below a root.
    """
    links = nodes.where("parent_id is not null").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count(F.lit(1)).alias("kids"))
    there = nodes.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("has"))
    nodes = nodes.join(links, ["trace_id", "span_id"], "left").join(there, ["trace_id", "parent_id"], "left")
    nodes = nodes.select("trace_id", "span_id", F.when(F.col("has"), F.col("parent_id")).alias("parent_id"), F.coalesce("kids", F.lit(0)).alias("kids"), "start_time")
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            _, par = _codes(t)
            inside = np.bincount(par[par >= 0], minlength=len(par))
            held = t.column("kids").to_numpy() - inside
            size, rounds, done = peel(par, held)
            top, steps = descend(par, rounds, done)
            span, up = t.column(1).combine_chunks(), t.column(2).combine_chunks()
            at = pa.array(np.maximum(top, 0))
            cols = [t.column(0).combine_chunks(), span, up, pa.array(size), pa.array(done), span.take(at), up.take(at), pa.array(steps)]
            rows = pa.RecordBatch.from_arrays(cols, ["trace_id", "span_id", "parent_id", "size", "peeled", "top", "hang", "steps"])
            if path:
                yield from _with_paths(rows, span, par, steps, done)
            else:
                yield rows

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= block_rows:
                yield from solve(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from solve(pa.Table.from_batches(held))

    shape = "trace_id string, span_id string, parent_id string, size bigint, peeled boolean, top string, hang string, steps bigint" + ", path array<string>" * path
    ranged = nodes.repartitionByRange(parts, "trace_id", "start_time", "span_id").sortWithinPartitions("trace_id", "start_time", "span_id")
    one = cut(ranged.mapInArrow(block, shape), "peeled")

    # what peeled nodes sent to nodes outside their block
    sent = one.where("peeled and hang is not null and steps = 0").groupBy("trace_id", F.col("hang").alias("span_id")).agg(F.sum(F.col("size") + 1).alias("more"))
    # inside a block a peeled node has already been added to a parent that wasn't peeled there
    inside = one.where("not peeled").select("trace_id", "span_id", "parent_id")
    # nodes that stay: weight is themselves and everything peeled below them
    rest = inside.join(sent, ["trace_id", "span_id"], "left").select("trace_id", "span_id", "parent_id", (F.coalesce("more", F.lit(0)) + 1).alias("weight"))
    solved = cut(_double(rest), "solved")
    if path:
        lines = _lift_paths(solved.where("depth >= 0").select("trace_id", "span_id", "parent_id"))
        solved = solved.join(lines, ["trace_id", "span_id"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    s = solved.select("trace_id", F.col("span_id").alias("hang"), F.col("root_span_id").alias("r"), F.col("depth").alias("d"), *([F.col("path").alias("q")] if path else []))
    low = one.where("peeled").join(s, ["trace_id", "hang"], "left").select(
        "trace_id",
        "span_id",
        "parent_id",
        F.when(F.col("hang").isNull(), F.col("top")).when(F.col("d") < 0, F.lit("")).otherwise(F.col("r")).alias("root_span_id"),
        F.when(F.col("hang").isNull(), F.col("steps")).when(F.col("d") < 0, F.lit(-2)).otherwise(F.col("d") + 1 + F.col("steps")).alias("depth"),
        F.col("size").alias("n_descendants"),
        F.lit(None).cast("string").alias("circle"),
        *([F.when(F.col("hang").isNull(), F.col("path")).when(F.col("d") < 0, F.array().cast("array<string>")).otherwise(F.concat("q", "path")).alias("path")] if path else []),
    )
    every = low.unionByName(solved)
    out = ["trace_id", "span_id", "root_span_id", "depth", "n_descendants", *(RANGES if ranges else []), *(["path"] if path else [])]
    return (_number(every) if ranges else every).select(*out)


def _double(rest: DataFrame) -> DataFrame:
    """Depth, root and sizes in a forest with weights, steps up doubling; for nodes
    on circles the circle's smallest identifier."""
    cur = rest.select(
        "trace_id",
        "span_id",
        "parent_id",
        F.col("parent_id").alias("up"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.when(F.col("parent_id").isNull(), F.col("span_id")).alias("root"),
        "weight",
        F.col("weight").alias("total"),
    )
    cur = cut(cur, "rest")
    n = cur.count()
    reach = 1
    while reach <= n and cur.where("up is not null").limit(1).count():
        over = cur.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("root").alias("r2"))
        add = cur.where("up is not null").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.sum("total").alias("more"))
        nxt = cur.join(over, ["trace_id", "up"], "left").join(add, ["trace_id", "span_id"], "left")
        nxt = nxt.select("trace_id", "span_id", "parent_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("root", "r2").alias("root"), "weight", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        cur = cut(nxt, "rest")
        reach *= 2
    none = F.lit(None).cast("string")
    fine = cur.where("up is null").select("trace_id", "span_id", "parent_id", F.col("root").alias("root_span_id"), "depth", (F.col("total") - 1).alias("n_descendants"), none.alias("circle"))
    bad = cur.where("up is not null")
    if not bad.limit(1).count():
        return fine
    # the steps up have gone all round: where they end is exactly the circles
    on = bad.select("trace_id", F.col("up").alias("span_id")).distinct()
    bad = cut(bad.join(on.withColumn("on", F.lit(True)), ["trace_id", "span_id"], "left").withColumn("on", F.coalesce("on", F.lit(False))), "circles")
    hung = bad.where("not on").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("total").alias("hung"))
    ring = bad.where("on").join(hung, ["trace_id", "span_id"], "left")
    ring = cut(ring.select("trace_id", "span_id", "parent_id", F.col("parent_id").alias("up"), F.col("span_id").alias("circle"), (F.col("weight") + F.coalesce("hung", F.lit(0))).alias("w")), "ring")
    m, reach = ring.count(), 1
    while reach <= m:
        ahead = ring.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("circle").alias("l2"))
        ring = cut(ring.join(ahead, ["trace_id", "up"]).select("trace_id", "span_id", "parent_id", F.col("up2").alias("up"), F.least("circle", "l2").alias("circle"), "w"), "ring")
        reach *= 2
    sums = ring.groupBy("trace_id", "circle").agg(F.sum("w").alias("sum"))
    rings = ring.join(sums, ["trace_id", "circle"]).select("trace_id", "span_id", "parent_id", F.lit("").alias("root_span_id"), F.lit(-1).cast("long").alias("depth"), (F.col("sum") - 1).alias("n_descendants"), "circle")
    under = bad.where("not on").select("trace_id", "span_id", "parent_id", F.lit("").alias("root_span_id"), F.lit(-2).cast("long").alias("depth"), (F.col("total") - 1).alias("n_descendants"), none.alias("circle"))
    return fine.unionByName(rings).unionByName(under)


def _lift(cur: DataFrame, value: str, add, label: str) -> DataFrame:
    """Puts together `value` along each node's way up (trace_id, span_id, up, value;
    up is null at the top, and no way is a circle), steps doubling."""
    cur = cut(cur, label)
    while cur.where("up is not null").limit(1).count():
        over = cur.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col(value).alias("v2"))
        nxt = cur.join(over, ["trace_id", "up"], "left")
        cur = cut(nxt.select("trace_id", "span_id", F.col("up2").alias("up"), F.when(F.col("up").isNull(), F.col(value)).otherwise(add(F.col("v2"), F.col(value))).alias(value)), label)
    return cur.drop("up")


def _lift_paths(fine: DataFrame) -> DataFrame:
    return _lift(fine.select("trace_id", "span_id", F.col("parent_id").alias("up"), F.array("span_id").alias("path")), "path", F.concat, "paths")


def _number(every: DataFrame) -> DataFrame:
    """Adds pos, first_pos and last_pos (see _numbered). The weight of the brothers
    before a node is a sum over range partitions with a carry from the earlier ones,
    so a node of any number of children is split; then these sums go up the ways."""
    every = cut(every, "every")
    ring = every.where("depth = -1").select("trace_id", F.col("span_id").alias("parent_id"), F.col("circle").alias("ring"))
    x = every.join(ring, ["trace_id", "parent_id"], "left")
    is_top = (F.col("depth") <= 0) & ((F.col("depth") > -2) | F.col("ring").isNotNull())
    x = x.select("trace_id", "span_id", "depth", "circle", F.col("n_descendants").alias("n"), F.when(~is_top, F.col("parent_id")).alias("up"), F.when(is_top, F.coalesce("circle", "ring", F.lit(""))).alias("k1"), (F.col("depth") == -2).alias("k2"))
    x = x.withColumn("w", F.when(F.col("depth") == -1, 1).otherwise(F.col("n") + 1)).withColumn("k0", F.col("depth") < 0)
    group, order = ["trace_id", "up"], ["k0", "k1", "k2", "span_id"]
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut(x.repartitionByRange(parts, *group, *order).withColumn("p", F.spark_partition_id()), "brothers")
    here = W.partitionBy(*group, "p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum("w").over(here), F.lit(0)))
    sums = x.groupBy(*group, "p").agg(F.sum("w").alias("sum"))
    carry = sums.select("trace_id", F.col("up").alias("up_"), "p", F.coalesce(F.sum("sum").over(W.partitionBy(*group).orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("carry"))
    x = x.alias("x").join(carry.alias("c"), (F.col("x.trace_id") == F.col("c.trace_id")) & F.col("x.up").eqNullSafe(F.col("c.up_")) & (F.col("x.p") == F.col("c.p")))
    step = F.col("before") + F.col("carry") + F.col("up").isNotNull().cast("long")
    at = _lift(x.select("x.trace_id", "span_id", "up", step.alias("pos")), "pos", lambda a, b: a + b, "places")
    got = every.join(at, ["trace_id", "span_id"])
    low = got.where("circle is not null").groupBy("trace_id", "circle").agg(F.min("pos").alias("low"))
    got = got.join(low, ["trace_id", "circle"], "left")
    first = F.when(F.col("depth") == -1, F.col("low")).otherwise(F.col("pos") + 1)
    last = F.when(F.col("depth") == -1, F.col("low") + F.col("n_descendants")).otherwise(F.col("pos") + F.col("n_descendants"))
    return got.withColumn("first_pos", first).withColumn("last_pos", last)


# --- the operator -------------------------------------------------------------


def hierarchy(nodes: DataFrame, path: bool = False, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS, ranges: bool = False) -> DataFrame:
    """Root, depth and number of descendants of every node; with path also the
    identifiers from the root down to the node; with ranges its place in the order
    of visit (pos, from 0 in each group) and the places first_pos .. last_pos of its
    descendants, which are all nodes of the group with a place in that range, the
    node itself (on a circle) left out: the list of descendants of any node, in
    one row however long the list is. See members.

    nodes: trace_id, span_id (unique in its trace_id), parent_id, start_time.
    A null parent, or one that is no node of the group, makes a root (depth 0,
    its own root). A node on a circle of parents (its own parent included) has
    depth -1, a node below one depth -2, both with root '' and an empty path; a
    circle node's descendants are the other nodes on and below its circle. Rows
    with a null trace_id or span_id are left out. Empty input gives no rows.

    Groups of up to group_rows nodes are peeled from the leaves in one task;
    larger ones in blocks (see _large).
    """
    nodes = nodes.select("trace_id", "span_id", "parent_id", "start_time").where("trace_id is not null and span_id is not null")
    nodes = cut(nodes, "nodes")
    hot = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("trace_id")
    found = hot.limit(HOT_LIST + 1).collect()
    big = None
    if found:
        if len(found) <= HOT_LIST:
            hot = F.broadcast(nodes.sparkSession.createDataFrame(found, hot.schema))
        big = nodes.join(hot, "trace_id", "left_semi")
        nodes = nodes.join(hot, "trace_id", "left_anti")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _group_chunks(batches, chunk_rows):
            yield from _whole(t, path, ranges)

    small = nodes.select("trace_id", "span_id", "parent_id").repartition("trace_id").sortWithinPartitions("trace_id").mapInArrow(solve, _out(path, ranges))
    return small if big is None else small.unionByName(_large(big, path, ranges, group_rows))


def span_hierarchy(spans: DataFrame, path: bool = False, **k) -> DataFrame:
    return hierarchy(distinct_spans(spans), path, **k)


def members(tree: DataFrame, of: DataFrame) -> DataFrame:
    """The descendants of chosen nodes as rows: trace_id, ancestor_id, descendant_id.
    tree: from hierarchy(ranges=True); of: trace_id, span_id of the nodes chosen. One row
    per pair, so choose few nodes or small ones; n_descendants tells how many rows come."""
    a = tree.join(of.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi").where("n_descendants > 0")
    a = a.select("trace_id", F.col("span_id").alias("ancestor_id"), F.col("first_pos").alias("a"), F.col("last_pos").alias("b"))
    x = tree.select("trace_id", F.col("span_id").alias("descendant_id"), "pos")
    return x.join(a, "trace_id").where("pos between a and b and ancestor_id <> descendant_id").select("trace_id", "ancestor_id", "descendant_id")
