"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.functions.ids import norm_id, norm_parent, utc_day
from spanloom.runtime import cut

#: A key with at least this share of all references is heavy; so there are at
#: most 1 / HEAVY_SHARE heavy keys, which bounds what is broadcast.
HEAVY_SHARE = 0.0001
#: References of one key that one task may get; keys that are not heavy but have
#: more are dealt to several tasks.
TASK_ROWS = 1_000_000
BASE = "/srv/spanstore/"


def _equal(a: Sequence[Column], b: Sequence[Column]) -> Column:
    cond = F.lit(True)
    for x, y in zip(a, b, strict=True):
        cond = cond & (x == y)
    return cond


def orphan_keys(refs: DataFrame, key: Sequence[str], period: str, targets: DataFrame, heavy_share: float = HEAVY_SHARE) -> tuple[DataFrame, DataFrame | None, DataFrame, int]:
    """Keys that refs name and targets lack.

    refs: one row per reference; key: its target's columns, called the same in
    targets. Returns (per key and period: n references without a target; the
    heavy missing keys, or None if no key is heavy; the other missing keys; how many
    references a key that isn't heavy has at most).

    References are first counted per key and period, so that whatever a key's
    share of the references, it reaches the join as one row per period. Keys
    that hold heavy_share of all references or more are looked up in targets by
    a broadcast of at most 1 / heavy_share rows; the others by a shuffled anti
    join. Nulls: a reference with a null in its key is no reference. Repeated
    targets count once. Empty targets: every key is missing. Empty refs: empty.
    """
    key = list(key)
    some = _equal([F.lit(1)], [F.lit(1)])
    for k in key:
        some = some & F.col(k).isNotNull()
    seen = Observation()
    counted = refs.where(some).groupBy(*key, F.col(period).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted.observe(seen, F.sum("n").alias("total")), "refs")
    targets = targets.select(*key)
    total = seen.get["total"] or 0  # counted while writing; a repeated task could only raise it, which makes fewer keys heavy
    floor = max(1, -(-total * heavy_share // 1))
    heavy = counted.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") > floor).select(*key)
    rows = heavy.collect() if total * heavy_share >= 1 else []  # at most 1 / heavy_share keys
    assert len(rows) <= 1 / heavy_share
    if rows:
        hot = F.broadcast(counted.sparkSession.createDataFrame(rows, heavy.schema))
        there = targets.join(hot, key, "left_semi").distinct()
        hot_missing = hot.join(F.broadcast(there), key, "left_anti")
        hot_missing = counted.sparkSession.createDataFrame(hot_missing.collect(), heavy.schema)
        rest = counted.join(hot, key, "left_anti").join(targets, key, "left_anti")
        lost = rest.unionByName(counted.join(F.broadcast(hot_missing), key, "left_semi"))
        return lost, hot_missing, rest.select(*key).distinct(), int(floor)
    rest = counted.join(targets, key, "left_anti")
    return rest, None, rest.select(*key).distinct(), int(floor)


def orphan_references(refs: DataFrame, key: Sequence[str], period: str, targets: DataFrame, heavy_share: float = HEAVY_SHARE, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of refs whose key is missing in targets (see orphan_keys). Rows
    of a heavy missing key are found by a broadcast of the bounded heavy keys;
    rows of other missing keys by a shuffled semi join, in which a key of over
    task_rows references is dealt to several tasks. So no task receives all
    references of one key."""
    key = list(key)
    _, hot, rest, most = orphan_keys(refs, key, period, targets, heavy_share)
    light = refs if hot is None else refs.join(F.broadcast(hot), key, "left_anti")
    deals = -(-most // task_rows)
    if deals > 1:
        light = light.withColumn("_deal", F.pmod(F.xxhash64(*light.columns), F.lit(deals)))
        rest = rest.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))
        out = light.join(rest, [*key, "_deal"], "left_semi").drop("_deal")
    else:
        out = light.join(rest, key, "left_semi")
    return out if hot is None else out.unionByName(refs.join(F.broadcast(hot), key, "left_semi"))


# --- the references of the span store -------------------------------------


def distinct_spans(spans: DataFrame) -> DataFrame:
    """One row per span: trace_id, span_id, parent_id, start_time of the first
    receipt. Spans without trace_id or span_id are left out."""
    return (
        spans.select(norm_id("trace_id").alias("trace_id"), norm_id("span_id").alias("span_id"), norm_parent("parent_span_id").alias("parent_id"), "start_time", "recv_no")
        .where("trace_id is not null and span_id is not null")
        .groupBy("trace_id", "span_id")
        .agg(F.min_by(F.struct("parent_id", "start_time"), F.coalesce("recv_no", F.lit(2**62))).alias("r"))
        .select("trace_id", "span_id", "r.parent_id", "r.start_time")
    )


def same_file(c: Column | str) -> Column:
    """A path without base, leading ./ and doubled slashes."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, "/{2,}", "/")
    c = F.regexp_replace(c, f"^(\\./)*{BASE}", "")
    return F.regexp_replace(c, "^(\\./)+", "")


def span_references(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = cut(distinct_spans(spans), "spans")  # both sides of the references come from it
    refs = s.where("parent_id is not null").select("trace_id", F.col("parent_id").alias("key_id"), "span_id", utc_day("start_time").alias("day"))
    return refs, s.select("trace_id", F.col("span_id").alias("key_id"))


def index_references(trace_index: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    refs = (
        trace_index.select(norm_id("trace_id").alias("trace_id"), "block_id", "indexed_at")
        .where("trace_id is not null and block_id is not null")
        .groupBy("trace_id", "block_id")
        .agg(F.date_format(F.min("indexed_at"), "yyyy-MM-dd").alias("day"))
    )
    return refs, blocks.where("deleted_at is null and block_id is not null").select("block_id").distinct()


def block_references(blocks: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    refs = (
        blocks.where("deleted_at is null and file_path is not null and block_id is not null")
        .groupBy("block_id", "file_path")
        .agg(F.date_format(F.min("created_at"), "yyyy-MM-dd").alias("day"))
        .withColumn("file", same_file("file_path"))
    )
    return refs, files.where("removed_at is null").select(same_file("file_path").alias("file")).where("file is not null").distinct()


def store_orphans(spans: DataFrame, trace_index: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """All references of the span store without a target: ref_table, ref_key,
    missing_key, period."""
    refs, targets = span_references(spans)
    a = orphan_references(refs, ["trace_id", "key_id"], "day", targets).select(F.lit("spans").alias("ref_table"), F.concat_ws(":", "trace_id", "span_id").alias("ref_key"), F.col("key_id").alias("missing_key"), F.col("day").alias("period"))
    refs, targets = index_references(trace_index, blocks)
    b = orphan_references(refs, ["block_id"], "day", targets).select(F.lit("trace_index").alias("ref_table"), F.col("trace_id").alias("ref_key"), F.col("block_id").cast("string").alias("missing_key"), F.col("day").alias("period"))
    refs, targets = block_references(blocks, files)
    c = orphan_references(refs, ["file"], "day", targets).select(F.lit("blocks").alias("ref_table"), F.col("block_id").cast("string").alias("ref_key"), F.col("file_path").alias("missing_key"), F.col("day").alias("period"))
    return a.unionByName(b).unionByName(c)


def store_orphan_counts(spans: DataFrame, trace_index: DataFrame, blocks: DataFrame, files: DataFrame) -> DataFrame:
    """References without a target, counted per table and UTC day."""
    out = None
    for name, (refs, targets), key in (
        ("spans", span_references(spans), ["trace_id", "key_id"]),
        ("trace_index", index_references(trace_index, blocks), ["block_id"]),
        ("blocks", block_references(blocks, files), ["file"]),
    ):
        lost, *_ = orphan_keys(refs, key, "day", targets)
        one = lost.groupBy("period").agg(F.sum("n").alias("n_orphans"), F.count(F.lit(1)).alias("n_missing_keys")).select(F.lit(name).alias("ref_table"), "period", "n_orphans", "n_missing_keys")
        out = one if out is None else out.unionByName(one)
    return out
