"""Percentiles of very large numeric columns from mergeable summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import cut

EPS = 0.005
#: Summaries of one group that one step merges.
FAN_IN = 64

#: A value (whole numbers stay whole: no rounding above 2 ** 53) and its ranks.
_TUPLES = {kind: np.dtype([("v", f"<{kind}8"), ("lo", "<i8"), ("hi", "<i8")]) for kind in "if"}
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Summary:
    """Tuples (value, lo, hi): the value's rank among the n values lies between
    lo and hi. err: how far the rank of an answer can be from the rank asked for."""

    __slots__ = ("n", "t")

    def __init__(self, n: int, t: np.ndarray):
        self.n, self.t = n, t

    @classmethod
    def of(cls, values: np.ndarray, eps: float) -> Summary:
        """values sorted; keeps every 2 eps n-th rank with the first and the last."""
        n = len(values)
        step = max(1, int(2 * eps * n))
        at = np.unique(np.concatenate([np.arange(0, n, step), [n - 1]])) if n else np.empty(0, np.int64)
        t = np.empty(len(at), _TUPLES[values.dtype.kind])
        t["v"], t["lo"], t["hi"] = values[at], at + 1, at + 1
        return cls(n, t)

    @property
    def err(self) -> float:
        if not self.n:
            return 0.0
        return float((self.t["hi"][1:] - self.t["lo"][:-1]).max(initial=0) / 2)

    @staticmethod
    def merge(parts: Sequence[Summary]) -> Summary:
        """Ranks add up: below a value lie at least the lo of each part's last
        tuple up to it, at most the hi of its first tuple above it, less one."""
        parts = [p for p in parts if p.n]
        if len(parts) < 2:
            return parts[0] if parts else Summary(0, np.empty(0, _TUPLES["f"]))
        v = np.concatenate([p.t["v"] for p in parts])
        src = np.repeat(np.arange(len(parts)), [len(p.t) for p in parts])
        idx = np.concatenate([np.arange(len(p.t)) for p in parts])
        order = np.lexsort((idx, src, v))
        v, src, idx = v[order], src[order], idx[order]
        lo, hi = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        for k, p in enumerate(parts):
            seen = np.cumsum(src == k)  # tuples of this part at or before each place
            own = src == k
            lo += np.where(seen > 0, p.t["lo"][np.maximum(seen - 1, 0)], 0)
            nxt = np.minimum(seen, len(p.t) - 1)
            up = np.where(seen < len(p.t), p.t["hi"][nxt] - 1, p.n)
            hi += np.where(own, p.t["hi"][np.maximum(seen - 1, 0)], up)
        t = np.empty(len(v), _TUPLES[v.dtype.kind])
        t["v"], t["lo"], t["hi"] = v, lo, hi
        return Summary(sum(p.n for p in parts), t)

    def compress(self, eps: float) -> Summary:
        """Drops tuples while the gap of two neighbours allows at most 2 eps n of uncertainty."""
        t, room = self.t, int(2 * eps * self.n)
        if len(t) < 3:
            return self
        keep, last = [0], 0
        lo, hi = t["lo"], t["hi"]
        while last < len(t) - 1:
            # the farthest tuple whose hi is still within reach of the last kept lo
            nxt = int(np.searchsorted(hi, lo[last] + room, "right")) - 1
            last = max(last + 1, min(nxt, len(t) - 1))
            keep.append(last)
        return Summary(self.n, t[keep])

    def query(self, q: float) -> float | int:
        """The value whose rank is nearest to q n (at least 1)."""
        r = max(1, int(np.ceil(q * self.n)))
        off = np.maximum(r - self.t["lo"], self.t["hi"] - r)
        return self.t["v"][int(np.argmin(off))].item()

    def pack(self) -> bytes:
        return self.t.dtype["v"].kind.encode() + self.t.tobytes()

    @classmethod
    def unpack(cls, n: int, raw: bytes) -> Summary:
        return cls(n, np.frombuffer(raw, _TUPLES[chr(raw[0])], offset=1))


def _key_shape(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def summarise(df: DataFrame, keys: Sequence[str], value: str, eps: float = EPS, rows: int = 250_000) -> DataFrame:
    """One summary per partition, block of rows and group: keys, slot, n, tuples,
    max_err. Rows with a null value or NaN are left out; null keys are a group.

    Each partition is summed up where it lies, so a group of any size moves as
    a few kB. Half of eps is spent here, half is left for merging.
    """
    keys = list(keys)
    shape = f"{_key_shape(df, keys)}, slot bigint, n bigint, tuples binary, max_err double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, 0

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            code = np.zeros(t.num_rows, np.int64)
            for k in keys:
                c = t.column(k).combine_chunks().dictionary_encode("encode")
                c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                ids = c.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                code = np.unique(code * (int(ids.max(initial=0)) + 1) + ids, return_inverse=True)[1]
            v = t.column(value).to_numpy()
            order = np.lexsort((v, code))
            code, v = code[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            ends = np.append(first[1:], len(v))
            sums = [Summary.of(v[a:b], eps / 2) for a, b in zip(first, ends, strict=True)]
            key_cols = t.select(keys).take(pa.array(order[first])).combine_chunks().columns
            slot = np.full(len(sums), part() * 1_000_003 + block)
            cols = [*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in key_cols), pa.array(slot), pa.array([s.n for s in sums], pa.int64()), pa.array([s.pack() for s in sums], pa.binary()), pa.array([s.err for s in sums], pa.float64())]
            return pa.RecordBatch.from_arrays(cols, [*keys, "slot", "n", "tuples", "max_err"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield close()
                held, n, block = [], 0, block + 1
        if n:
            yield close()

    whole = is_whole(df, value)
    v = F.col(value).cast("bigint" if whole else "double")
    return df.where(v.isNotNull() if whole else v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias(value)).mapInArrow(run, shape)


def is_whole(df: DataFrame, value: str) -> bool:
    return dict(df.dtypes)[value] in _WHOLE


def part() -> int:
    from pyspark import TaskContext

    c = TaskContext.get()
    return c.partitionId() if c else 0


def merge_summaries(parts: DataFrame, keys: Sequence[str], eps: float = EPS, fan_in: int = FAN_IN, levels: int | None = None) -> DataFrame:
    """Merges summaries of the same group: keys, n, tuples, max_err.

    Summaries may come from partitions, days or batches. They are merged
    fan_in at a time and compressed after each level, so that no task holds
    all summaries of a group; the levels share half of eps, and max_err tells
    the rank error that the result really has.
    """
    keys = list(keys)
    if "slot" not in parts.columns:
        parts = parts.withColumn("slot", F.xxhash64("tuples", "n"))
    if levels is None:
        parts = cut(parts, "summaries")
        slots = parts.select("slot").distinct().count()
        levels = max(1, int(np.ceil(np.log(max(2, slots)) / np.log(fan_in))))
    shape = f"{_key_shape(parts, keys)}, slot bigint, n bigint, tuples binary, max_err double"

    for level in range(levels, 0, -1):
        spread = fan_in ** (level - 1)
        parts = parts.withColumn("slot", F.pmod(F.xxhash64("slot", F.lit(level)), F.lit(spread)) if spread > 1 else F.lit(0).cast("long"))
        group = [*keys, "slot"]
        room = eps / 2 * (1 + (levels - level + 1) / levels)  # half of eps went into the summaries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            out: list[tuple] = []

            def close() -> None:
                s = Summary.merge([Summary.unpack(r[-2], r[-1]) for r in held])
                if len(held) > 1:
                    s = s.compress(room)
                out.append((*held[0][:-2], s.n, s.pack(), s.err))

            def flush() -> pa.RecordBatch:
                cols = list(zip(*out, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [*keys, "slot", "n", "tuples", "max_err"])

            types = None
            for b in batches:
                if types is None:
                    types = [*(f.type for f in b.schema)][: len(keys)] + [pa.int64(), pa.int64(), pa.binary(), pa.float64()]
                for r in zip(*(b.column(i).to_pylist() for i in range(len(keys) + 3)), strict=True):
                    if held and held[0][:-2] != r[:-2]:
                        close()
                        held = []
                        if len(out) >= 5_000:
                            yield flush()
                            out.clear()
                    held.append(r)
            if held:
                close()
            if out:
                yield flush()

        parts = parts.select(*keys, "slot", "n", "tuples").repartition(*group).sortWithinPartitions(*group).mapInArrow(run, shape)
    return parts.drop("slot")


def answers(summaries: DataFrame, keys: Sequence[str], quantiles: Sequence[float], whole: bool = False) -> DataFrame:
    """keys, q, value, n, max_err: one row per group and quantile. whole: the summaries
    are of whole numbers, and so is value."""
    keys, quantiles = list(keys), list(quantiles)
    shape = f"{_key_shape(summaries, keys)}, q double, value {'bigint' if whole else 'double'}, n bigint, max_err double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, raw, err = (b.column(i).to_pylist() for i in range(len(keys), len(keys) + 3))
            k = len(quantiles)
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            vals = [Summary.unpack(x, y).query(q) for x, y in zip(n, raw, strict=True) for q in quantiles]
            cols = [*(b.column(i).take(at) for i in range(len(keys))), pa.array(np.tile(quantiles, b.num_rows).astype(float)), pa.array(vals, pa.int64() if whole else pa.float64()), b.column(len(keys)).take(at), b.column(len(keys) + 2).take(at)]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "q", "value", "n", "max_err"])

    return summaries.select(*keys, "n", "tuples", "max_err").mapInArrow(run, shape)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], eps: float = EPS) -> DataFrame:
    """Percentiles per group; a value's rank is off by at most eps n (max_err tells it in ranks)."""
    return answers(merge_summaries(summarise(df, keys, value, eps), keys, eps), keys, quantiles, is_whole(df, value))


def rank_check(df: DataFrame, keys: Sequence[str], value: str, got: DataFrame, eps: float = EPS) -> DataFrame:
    """keys, q, n, in_bound: answers held against the exact ranks of their values in df."""
    keys = list(keys)
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    r = x.join(got.select(*keys, "q", "value"), keys).groupBy(*keys, "q").agg(
        F.sum("k").alias("n"),
        F.sum(F.when(F.col("v") < F.col("value"), F.col("k")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("value"), F.col("k")).otherwise(0)).alias("upto"),
        F.max(F.col("v") == F.col("value")).alias("is_one"),
    )
    want = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    room = F.lit(eps) * F.col("n") + 1
    return r.select(*keys, "q", "n", ((F.col("below") + 1 <= want + room) & (F.col("upto") >= want - room) & F.col("is_one")).alias("in_bound"))
