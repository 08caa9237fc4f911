"""Filling fixed-capacity containers with items."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import VOCABULARY, token_counts
from spanloom.runtime import cut

#: Items of one class that are packed together.
GROUP_ITEMS = 50_000
#: Rounds in which groups above their bound exchange items.
ROUNDS = 3
#: Orders in which one exchange is packed anew; the best packing is kept.
ATTEMPTS = 8
#: How much these orders differ from that of the sizes.
SHAKE = 0.1
#: Kinds of containers that each text is looked at for in one pass; more take more passes.
CLASS_BLOCK = 1000
#: Largest k of the second family of the lower bound.
MOST_K = 100

_SHAPE = "pack_class string, capacity bigint, grp string, container string, doc_id bigint, piece bigint, tokens bigint, gap bigint, bound bigint, bins bigint"


def best_fit_decreasing(sizes: np.ndarray, capacity: int, order: np.ndarray | None = None) -> np.ndarray:
    """Container number of each item. sizes: 1 .. capacity. Each item, the largest
    first (or in the given order), goes where it leaves the smallest gap."""
    out = np.empty(len(sizes), np.int64)
    gaps: list[int] = []  # distinct gaps of open containers, sorted
    where: dict[int, list[int]] = {}
    n = 0
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        s = int(sizes[i])
        k = bisect_left(gaps, s)
        if k < len(gaps):
            g = gaps[k]
            box = where[g].pop()
            if not where[g]:
                del where[g], gaps[k]
        else:
            g, box = capacity, n
            n += 1
        out[i] = box
        left = g - s
        if left:
            if left not in where:
                where[left] = []
                insort(gaps, left)
            where[left].append(box)
    return out


def lower_bound(sizes: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """No packing takes fewer containers. The best of three families of dual
    feasible functions: the sizes' sum; sizes rounded down to parts of k + 1;
    sizes below e left out with those above capacity - e counted whole, for every e.
    times: how often each of the sizes occurs, if they are listed once."""
    if not len(sizes):
        return 0
    x, at = np.unique(sizes.astype(np.int64), return_inverse=True)
    times = np.bincount(at, weights=times, minlength=len(x)).astype(np.int64) if times is not None else np.bincount(at)
    best = -(-int((x * times).sum()) // capacity)
    for k in range(1, MOST_K + 1):
        whole = (k + 1) * x % capacity == 0
        # in units of 1 / (k * capacity): x itself where (k + 1) x is whole, else floor((k + 1) x) / k
        u = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((u * times).sum()) // (k * capacity)))
    e = np.unique(np.concatenate([x[x <= capacity // 2], [0]]))
    total, count = np.concatenate([[0], np.cumsum(x * times)]), np.concatenate([[0], np.cumsum(times)])
    big = np.searchsorted(x, capacity - e, "right")
    small = np.searchsorted(x, e)
    mid = total[np.maximum(big, small)] - total[small]
    u = (count[-1] - count[big]) * capacity + mid
    return max(best, int(-(-u.max() // capacity)))


def _filled(pdf: pd.DataFrame, box: np.ndarray, bound: int, tag: str) -> pd.DataFrame:
    cap, sizes = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy(np.int64)
    n = int(box.max()) + 1
    full = np.bincount(box, weights=sizes, minlength=n).astype(np.int64)
    g = f"{tag}{pdf['grp'].iloc[0]}"
    got = pdf.assign(grp=g, container=[f"{g}-{b}" for b in box.tolist()], gap=cap - full[box], bound=bound, bins=n)
    return got[[c.split()[0] for c in _SHAPE.split(", ")]]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    cap, sizes = int(pdf["capacity"].iloc[0]), pdf["tokens"].to_numpy(np.int64)
    return _filled(pdf, best_fit_decreasing(sizes, cap), lower_bound(sizes, cap), "b")


def repacked(sizes: np.ndarray, capacity: int, box: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """(container numbers, lower bound) of items that are packed in box already: best
    fit decreasing in several orders near that of the sizes, until the bound is
    reached; box itself (numbered anew) where none takes fewer containers."""
    bound = lower_bound(sizes, capacity)
    best = np.unique(box, return_inverse=True)[1]
    n = int(best.max()) + 1
    rnd = np.random.default_rng(seed)
    for k in range(ATTEMPTS):
        if n <= bound:
            break
        near = sizes * (1 + (SHAKE * rnd.random(len(sizes)) if k else 0))
        got = best_fit_decreasing(sizes, capacity, np.argsort(-near, kind="stable"))
        if got.max() + 1 < n:
            best, n = got, int(got.max()) + 1
    return best, bound


def _exchange(r: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        box = pdf["container"].astype("category").cat.codes.to_numpy()
        got, bound = repacked(pdf["tokens"].to_numpy(np.int64), int(pdf["capacity"].iloc[0]), box, r)
        return _filled(pdf, got, bound, f"x{r}-")

    return again


def pack(sizes: DataFrame, classes: DataFrame, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Containers for every class: pack_class, capacity, grp, container, doc_id,
    piece, tokens, gap (unused tokens of the container).

    sizes: doc_id, n_tokens; classes: pack_class, capacity_tokens (null or below
    1: left out). An item above the capacity fills containers of its own but for
    its last piece, which is packed like an item (piece numbers from 0). Items of
    size 0 or null need no container. Repeated doc_ids are items of their own.

    Items are dealt into groups of about group_items by hash and packed by best
    fit decreasing. A group that reaches its lower bound is certified optimal.
    The others, be it one alone, give the items of all containers with a gap into
    an exchange: containers of all such groups of a class are dealt anew into sets of
    about group_items items, and each set is packed in several orders. A set
    keeps the better of its old and its new packing. It is a group of its own from
    then on (see packing_bounds). Rounds end when all is certified.
    """
    known = classes.where("pack_class is not null and capacity_tokens >= 1").select("pack_class", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    sizes = cut(sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).withColumn("no", F.monotonically_increasing_id()), "sizes")
    groups = max(1, -(-sizes.count() // group_items))
    out, block = None, []

    def add() -> DataFrame:
        one = _pack_block(sizes, block, groups, group_items, rounds)
        return one if out is None else out.unionByName(one)

    for r in known.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == CLASS_BLOCK:
            out, block = add(), []
    if block or out is None:
        out = add()
    return out


def _pack_block(sizes: DataFrame, rows: list[tuple[str, int]], groups: int, group_items: int, rounds: int) -> DataFrame:
    kinds = [F.struct(F.lit(r[0]).alias("pack_class"), F.lit(r[1]).cast("long").alias("capacity")) for r in rows]
    none = F.array().cast("array<struct<pack_class:string,capacity:bigint>>")
    both = sizes.select("doc_id", "no", "n_tokens", F.explode(F.array(*kinds) if kinds else none).alias("c")).select("doc_id", "no", "n_tokens", "c.*")
    cap, n = F.col("capacity"), F.col("n_tokens")
    own = F.call_function("div", n, cap)
    rest = n % cap
    whole = both.where(n >= cap).select("pack_class", "capacity", "doc_id", "no", F.explode(F.sequence(F.lit(0).cast("long"), own - 1)).alias("piece"))
    whole = whole.select("pack_class", "capacity", F.lit("whole").alias("grp"), F.concat_ws("-", F.lit("w"), "no", "piece").alias("container"), "doc_id", "piece", F.col("capacity").alias("tokens"), F.lit(0).cast("long").alias("gap"))
    items = both.select("pack_class", "capacity", "doc_id", "no", F.when(n >= cap, own).otherwise(0).cast("long").alias("piece"), rest.alias("tokens")).where("tokens > 0")
    items = items.withColumn("grp", F.pmod(F.xxhash64("no"), F.lit(groups))).drop("no")
    done = cut(items.groupBy("pack_class", "grp").applyInPandas(_pack, _SHAPE), "packed")
    for r in range(1, rounds + 1):
        open_ = (F.col("bins") > F.col("bound")) & (F.col("gap") > 0)
        pool = done.where(open_)
        m = pool.groupBy("pack_class").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
        if not m:
            break
        sets = -(-m // group_items)

        dealt = pool.withColumn("grp", F.pmod(F.xxhash64("container", F.lit(r)), F.lit(sets)))
        done = cut(done.where(~open_).unionByName(dealt.groupBy("pack_class", "grp").applyInPandas(_exchange(r), _SHAPE)), "round")
    return done.select("pack_class", "capacity", "grp", "container", "doc_id", "piece", "tokens", "gap").unionByName(whole)


def packing_bounds(packed: DataFrame, by: Sequence[str] = ("grp",)) -> DataFrame:
    """pack_class, capacity, by, n_pieces, tokens, bins, bound, certified: containers of each
    group (or with by=() of each class) and how many its items need at least, from the
    numbers of items of each size."""
    keys = ["pack_class", "capacity", *by]
    bins = packed.groupBy(*keys).agg(F.countDistinct("container").alias("bins"))
    sizes = packed.groupBy(*keys, "tokens").agg(F.count(F.lit(1)).alias("times"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t = pdf["tokens"].to_numpy(np.int64), pdf["times"].to_numpy(np.int64)
        got = pdf[keys].iloc[:1].assign(n_pieces=t.sum(), tokens=(x * t).sum(), bound=lower_bound(x, int(pdf["capacity"].iloc[0]), t))
        return got

    shape = "pack_class string, capacity bigint, " + "".join(f"{c} string, " for c in by) + "n_pieces bigint, tokens bigint, bound bigint"
    got = sizes.groupBy(*keys).applyInPandas(bound, shape).join(bins, keys)
    return got.select(*keys, "n_pieces", "tokens", "bins", "bound", (F.col("bins") == F.col("bound")).alias("certified"))


def packed_documents(documents: DataFrame, classes: DataFrame, vocabulary: str = VOCABULARY, **k) -> DataFrame:
    return pack(token_counts(documents, vocabulary), classes, **k)


def packing_summary(packed: DataFrame) -> DataFrame:
    """Each class: n_pieces, tokens, bins, bound, certified (see packing_bounds) and fill,
    the share of its containers that is used."""
    return packing_bounds(packed, ()).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))


def packing_check(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each class: n_docs, and whether each document is there once with pieces that sum to its
    tokens, no container is above its capacity, nothing but a document above the capacity
    is divided, no group has fewer containers than its bound, and every group above it
    has been through an exchange."""
    packed = cut(packed, "checked")
    want = sizes.where("n_tokens > 0").groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("times"))
    docs = packed.groupBy("pack_class", "capacity", "doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("numbers")).join(want, "doc_id", "left")
    whole = F.coalesce((F.col("got") == F.col("n_tokens")) & ((F.col("times") > 1) | ((F.col("pieces") == F.col("numbers")) & (F.col("pieces") == F.ceil(F.col("n_tokens") / F.col("capacity"))))), F.lit(False))
    a = docs.groupBy("pack_class", "capacity").agg(F.count(F.lit(1)).alias("n_docs"), F.min(whole).alias("whole"))
    boxes = packed.groupBy("pack_class", "capacity", "container").agg(F.sum("tokens").alias("full"), F.max("gap").alias("gap"))
    b = boxes.groupBy("pack_class", "capacity").agg(F.min((F.col("full") <= F.col("capacity")) & (F.col("gap") == F.col("capacity") - F.col("full"))).alias("within_capacity"))
    g = packing_bounds(packed)
    c = g.groupBy("pack_class", "capacity").agg(F.min(F.col("bins") >= F.col("bound")).alias("bounds_hold"), F.min(F.col("certified") | F.startswith("grp", F.lit("x"))).alias("open_ones_repacked"))
    return a.join(b, ["pack_class", "capacity"]).join(c, ["pack_class", "capacity"])
