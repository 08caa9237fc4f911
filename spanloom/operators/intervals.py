"""Overlapping and gapped time intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.ids import norm_id
from spanloom.runtime import cut

#: Distinct starts of one entity that one window task takes; beyond it the
#: entity is cut into slices.
SLICE_ROWS = 100_000
#: Large entities up to this number are told to all tasks; beyond it they are joined.
HOT_LIST = 10_000


def _sliced(iv: DataFrame, slice_rows: int) -> DataFrame:
    """Adds slice and carry (the latest end of all earlier slices of the entity).

    Entities of up to slice_rows starts are one slice. The starts of larger ones
    are cut by rank: range partitions of sampled (entity, start), aiming at half
    of slice_rows, so that clustered starts make no large slice. A slice sees of
    the earlier ones only their latest end.
    """
    none = F.lit(None).cast(dict(iv.dtypes)["end"])
    large = iv.groupBy("entity").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > slice_rows)
    found = large.limit(HOT_LIST + 1).collect()
    if not found:
        return iv.withColumns({"slice": F.lit(0), "carry": none})
    if len(found) <= HOT_LIST:
        rows, names = sum(r["k"] for r in found), F.broadcast(iv.sparkSession.createDataFrame([(r["entity"],) for r in found], iv.select("entity").schema))
    else:
        large = cut(large, "large")
        rows, names = large.agg(F.sum("k")).first()[0], large.select("entity")
    parts = -(-2 * rows // slice_rows)
    big = iv.join(names, "entity", "left_semi").repartitionByRange(parts, "entity", "start").withColumn("slice", F.spark_partition_id())
    big = cut(big, "slices")
    ends = big.groupBy("entity", "slice").agg(F.max("end").alias("last"))
    before = W.partitionBy("entity").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select("entity", "slice", F.max("last").over(before).alias("carry"))
    small = iv.join(names, "entity", "left_anti").withColumns({"slice": F.lit(0), "carry": none})
    return small.unionByName(big.join(carry, ["entity", "slice"]))


def merge_intervals(intervals: DataFrame, slice_rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Continuous periods and gaps of each entity's intervals.

    intervals: entity, start, end with start <= end (others and rows with a null
    are left out; start = end is a point). Returns periods (entity,
    period_start, period_end, n_starts) and gaps (entity, gap_start, gap_end
    with gap_end > gap_start). Intervals that touch leave no gap.

    Equal starts are first folded into their latest end on the map side, which
    also folds repeated rows; then each start is compared with the running
    maximum of the earlier ends. A large entity is cut into slices (see
    _sliced), so no task holds a whole large entity.
    """
    iv = intervals.select("entity", "start", "end").where("entity is not null and start <= end").groupBy("entity", "start").agg(F.max("end").alias("end"))
    iv = _sliced(cut(iv, "starts"), slice_rows)
    w = W.partitionBy("entity", "slice").orderBy("start")
    seen = F.greatest(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("carry"))
    iv = iv.withColumn("seen", seen).withColumn("new", (F.col("seen").isNull() | (F.col("start") > F.col("seen"))).cast("int"))
    iv = iv.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    gaps = iv.where("new = 1 and seen is not null").select("entity", F.col("seen").alias("gap_start"), F.col("start").alias("gap_end"))
    # island 0 of a slice goes on from the slice before: its end counts for the period before
    part = iv.groupBy("entity", "slice", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.count(F.lit(1)).alias("n"))
    count = part.groupBy("entity", "slice").agg(F.max("island").alias("m"))
    before = W.partitionBy("entity").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    first = count.select("entity", "slice", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    starts = part.join(first, ["entity", "slice"]).withColumn("no", F.col("first") + F.col("island"))
    periods = starts.groupBy("entity", "no").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"), F.sum("n").alias("n_starts")).drop("no")
    return periods, gaps


def span_intervals(spans: DataFrame) -> DataFrame:
    return spans.select(norm_id("trace_id").alias("entity"), F.col("start_time").alias("start"), F.col("end_time").alias("end"))


def trace_gaps(spans: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    _, gaps = merge_intervals(span_intervals(spans), slice_rows)
    return gaps.withColumnRenamed("entity", "trace_id")


def trace_periods(spans: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    periods, _ = merge_intervals(span_intervals(spans), slice_rows)
    return periods.withColumnRenamed("entity", "trace_id")
