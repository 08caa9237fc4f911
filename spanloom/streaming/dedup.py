"""Messages delivered more than once: one copy of each is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.functions.ids import floor_div, norm_id
from spanloom.runtime import drop_path, exists, work_path

#: A message is looked for in the state if its event time lies at most this far
#: behind the latest one, else in the shelves of what was kept before.
DELAY_MS = 6 * 3_600_000
#: Event time covered by one state value; a value expires as a whole.
SLICE_MS = 3_600_000
#: Event time covered by one folder of kept messages: a day in small stores, down to
#: an hour where a day has many messages.
SHELF_MS, SHELF_LEAST_MS, SHELF_ROWS = 24 * 3_600_000, 3_600_000, 20_000_000
#: Messages per bucket of the state, over all slices.
BUCKET_ROWS = 50_000
#: A finite table is delivered in at least this many micro-batches, of at most this many rows.
STEPS, STEP_ROWS = 6, 20_000_000

_SEEN = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("kept", "<i8"), ("ms", "<i8")])
_SHAPE = "bucket int, slot int, h1 bigint, h2 bigint, recv_no bigint, ms bigint, first_here bigint"
_OUT = "h1 bigint, h2 bigint, recv_no bigint, kept_recv_no bigint, ms bigint, kind string"
_KEPT = "h1 bigint, h2 bigint, recv_no bigint"


def _firsts(h1: np.ndarray, h2: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest number of its identifier, and whether the row
    is the one that holds it (one row, even if the number is repeated)."""
    order = np.lexsort((no, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    first = np.empty(len(order), np.int64)
    first[order] = no[order][new][group] if len(order) else first
    is_first = np.zeros(len(order), bool)
    is_first[order[new]] = True
    return first, is_first


def _router(buckets: int, slots: int):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies that lie in one batch point to the first of them and are spread
        over all buckets; so an identifier of any number of copies is no hot key."""
        for b in batches:
            h1, h2, no, ms = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            first, is_first = _firsts(h1, h2, no)
            bucket = np.where(is_first, h1, no * 0x9E3779B1) % buckets
            slot = ms // SLICE_MS % slots
            cols = [pa.array(bucket.astype(np.int32)), pa.array(slot.astype(np.int32)), *map(pa.array, (h1, h2, no, ms)), pa.array(first, mask=is_first)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "slot", "h1", "h2", "recv_no", "ms", "first_here"])

    return local


def _seen(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Tells new messages, copies, and messages whose slice has expired."""
    x = pd.concat(list(pdfs), ignore_index=True)
    here = x["first_here"].notna().to_numpy()
    h1, h2, no, ms = (x[c].to_numpy(np.int64) for c in ("h1", "h2", "recv_no", "ms"))
    kept = x["first_here"].fillna(0).to_numpy(np.int64)
    mark = state.getCurrentWatermarkMs()
    late = (ms // SLICE_MS + 1) * SLICE_MS <= mark
    kind = np.where(here, "copy", np.where(late, "late", "")).astype(object)
    old = np.frombuffer(state.get[0], _SEEN) if state.exists else np.empty(0, _SEEN)
    live = old[(old["ms"] // SLICE_MS + 1) * SLICE_MS > mark]
    go = np.flatnonzero(~here & ~late)
    # what the state knows sorts before every message: its place in the line is -1
    line = np.concatenate([np.full(len(live), -1), no[go]])
    a, b = np.concatenate([live["h1"], h1[go]]), np.concatenate([live["h2"], h2[go]])
    _, is_first = _firsts(a, b, line)
    order = np.lexsort((line, b, a))
    lead = np.maximum.accumulate(np.where(is_first[order], np.arange(len(order)), 0))
    holder = np.empty(len(order), np.int64)
    holder[order] = order[lead]  # the row that stands for the identifier
    own = is_first[len(live) :]
    kept[go] = np.concatenate([live["kept"], no[go]])[holder[len(live) :]]
    kind[go] = np.where(own, "new", "copy")
    add = go[own]
    if len(add) or len(live) < len(old):
        fresh = np.empty(len(add), _SEEN)
        fresh["h1"], fresh["h2"], fresh["kept"], fresh["ms"] = h1[add], h2[add], no[add], ms[add]
        now = np.concatenate([live, fresh])
        if len(now):
            state.update((now.tobytes(),))
        else:
            state.remove()
    yield pd.DataFrame({"h1": h1, "h2": h2, "recv_no": no, "kept_recv_no": kept, "ms": ms, "kind": kind})


def _shelve(new: DataFrame, root: str, batch: int, shelf_ms: int) -> None:
    """Puts kept messages into the folders of their event times. A repeated batch
    replaces its own folders only."""
    x = new.select("h1", "h2", "recv_no", floor_div("ms", shelf_ms).alias("shelf"), F.lit(batch).cast("long").alias("batch"))
    x = x.hint("rebalance", "shelf")  # small shelves share a task, a hot one is split by size
    x.write.partitionBy("shelf", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/seen")


def _on_shelves(spark: SparkSession, root: str, shelves: list[int], batch: int) -> DataFrame:
    """What batches before this one kept in the given shelves; only these are listed and read."""
    there = [p for p in (f"{root}/seen/shelf={n}" for n in shelves) if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], _KEPT)
    r = spark.read.schema(f"{_KEPT}, shelf bigint, batch bigint").option("basePath", f"{root}/seen")
    return r.parquet(*there).where(F.col("batch") < batch).select("h1", "h2", "recv_no")


def _batch_writer(root: str, shelf_ms: int = SHELF_MS):
    def write(df: DataFrame, batch: int) -> None:
        """One folder per batch, overwritten when a batch is repeated after a
        failure, as its state is: output and state stay in step."""
        s = df.sparkSession
        told = f"{root}/told/batch={batch}"
        df.write.mode("overwrite").partitionBy("kind").parquet(told)
        got = s.read.schema(_OUT).parquet(told)
        new, late = got.where("kind = 'new'"), got.where("kind = 'late'").drop("kind", "kept_recv_no")
        shelves = [r[0] for r in late.select(floor_div("ms", shelf_ms)).distinct().collect()]
        if shelves:  # late-arrival lookup, in the shelves of the late messages' event times
            known = _on_shelves(s, root, shelves, batch).join(late.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min("recv_no").alias("known"))
            own = late.groupBy("h1", "h2").agg(F.min(F.struct("recv_no", "ms")).alias("own")).select("h1", "h2", F.col("own.recv_no").alias("own"))
            out = late.join(own.join(known, ["h1", "h2"], "left"), ["h1", "h2"])
            first = F.col("known").isNull() & (F.col("recv_no") == F.col("own"))
            out = out.select("h1", "h2", "recv_no", F.coalesce("known", "own").alias("kept_recv_no"), "ms", F.when(first, "new").otherwise("copy").alias("kind"))
            path = f"{root}/late/batch={batch}"
            out.write.mode("overwrite").partitionBy("kind").parquet(path)
            new = new.unionByName(s.read.schema(_OUT).parquet(path).where("kind = 'new'"))
        _shelve(new, root, batch, shelf_ms)

    return write


def dedup_stream(messages: DataFrame, root: str, delay_ms: int = DELAY_MS, buckets: int = 64, shelf_ms: int = SHELF_MS) -> None:
    """Runs a stream of messages (h1, h2: 128 bits of the identifier's hash,
    recv_no, ms: event time, -1 where it has none) to its end; writes below root,
    batch by batch, which messages are new and which are copies.

    The copies of a message are the same message and so bear its event time. The
    state holds the identifiers seen, in one value per bucket and hour of event
    time. Hours live in a ring of slots: an hour that the watermark (the latest
    event time less delay_ms) has passed is expired and makes room for the
    next, so the state never holds more than the ring, and a micro-batch
    rewrites only the hours it touches. A message of an expired hour, or without
    event time, is looked up in the shelf of what was kept at its event time, not
    in all history.
    """
    slots = -(-delay_ms // SLICE_MS) + 2
    told = messages.select("h1", "h2", "recv_no", "ms").mapInArrow(_router(buckets, slots), _SHAPE).withColumn("event_time", F.timestamp_millis("ms")).withWatermark("event_time", f"{delay_ms} milliseconds")
    told = told.groupBy("bucket", "slot").applyInPandasWithState(_seen, _OUT, "seen binary", "append", GroupStateTimeout.NoTimeout)
    q = told.writeStream.outputMode("append").foreachBatch(_batch_writer(root, shelf_ms)).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def told(spark: SparkSession, root: str, kind: str = "copy") -> DataFrame:
    """The messages of a kind (new or copy), with the batch that brought them."""
    df = spark.createDataFrame([], f"{_OUT}, batch bigint")
    for name in ("told", "late"):
        if exists(spark, f"{root}/{name}"):
            df = df.unionByName(spark.read.schema(f"{_OUT}, batch bigint").parquet(f"{root}/{name}").where(F.col("kind") == kind))
    return df


def copies(spark: SparkSession, root: str, settle: bool = False) -> DataFrame:
    """first_recv_no and copy_recv_no of each message after an identifier's first.
    First is the smallest number, whatever order the batches came in. Only the
    copies are gathered, not what was kept once.

    settle: for a feed whose copies may bear other event times than their
    message, which neither the state nor the shelves can then find: all that was
    kept is gone through once more for identifiers that were kept twice.
    """
    copy = told(spark, root)
    receipts = copy.select("h1", "h2", "recv_no").unionByName(copy.select("h1", "h2", F.col("kept_recv_no").alias("recv_no")))
    if settle:
        new = told(spark, root, "new").select("h1", "h2", "recv_no")
        twice = new.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2")
        receipts = receipts.unionByName(new.join(twice, ["h1", "h2"], "left_semi"))
    receipts = receipts.distinct()
    first = receipts.groupBy("h1", "h2").agg(F.min("recv_no").alias("first_recv_no"))
    return receipts.join(first, ["h1", "h2"]).where("recv_no > first_recv_no").select("first_recv_no", F.col("recv_no").alias("copy_recv_no"))


def span_messages(spans: DataFrame) -> DataFrame:
    """Receipts of spans as messages. Rows without trace_id, span_id or recv_no
    take no part; a missing start_time is no event time (-1)."""
    t, s = norm_id("trace_id"), norm_id("span_id")
    ms = F.coalesce(floor_div("start_time", 1_000_000), F.lit(-1).cast("long"))
    x = spans.select(t.alias("t"), s.alias("s"), F.col("recv_no").cast("long").alias("recv_no"), ms.alias("ms"), *(["batch_no"] if "batch_no" in spans.columns else []))
    x = x.where("t is not null and s is not null and recv_no is not null")
    return x.select(F.xxhash64("t", "s").alias("h1"), F.xxhash64("s", F.lit("|"), "t").alias("h2"), "recv_no", "ms", *x.columns[4:])


def deliver(messages: DataFrame, folder: str, n: int, steps: int = STEPS) -> int:
    """Lays about n messages down as files in the order of their delivery (batch_no,
    recv_no): the files' times follow that order. Returns how many files make one
    micro-batch, so that there are at least `steps` of them."""
    spark = messages.sparkSession
    steps = max(steps, -(-n // STEP_ROWS))
    per = max(1, min(spark.sparkContext.defaultParallelism, n // steps // 50_000))
    by = [c for c in ("batch_no", "recv_no") if c in messages.columns]
    messages.repartitionByRange(steps * per, *by).select("h1", "h2", "recv_no", "ms").write.parquet(folder)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for i, f in enumerate(files):  # one entry per file; the store's order is kept if times can't be set
        fs.setTimes(f, 1_600_000_000_000 + i * 1000, -1)
    return per


def run_spans(spark: SparkSession, path: str, delay_ms: int = DELAY_MS, steps: int = STEPS) -> str:
    """Streams the receipts below path in their order of delivery; returns the folder of what was told."""
    root = work_path(spark, "dedup")
    spans = spark.read.parquet(path)
    n = spans.count()  # from the files' footers
    per = deliver(span_messages(spans), f"{root}/landed", n, steps)
    stream = spark.readStream.schema(f"{_KEPT}, ms bigint").option("maxFilesPerTrigger", per).parquet(f"{root}/landed")
    dedup_stream(stream, root, delay_ms, max(4, -(-n // BUCKET_ROWS)), max(SHELF_LEAST_MS, SHELF_MS // (1 + n // SHELF_ROWS)))
    drop_path(spark, f"{root}/state")
    drop_path(spark, f"{root}/landed")
    return root


def span_copies(spark: SparkSession, path: str, settle: bool = False, **k) -> DataFrame:
    """Copies among the receipts below path (see copies), found by a stream over them."""
    return copies(spark, run_spans(spark, path, **k), settle)


def span_kept(spark: SparkSession, path: str, **k) -> DataFrame:
    """The spans at path with one receipt of each span; rows without identifiers aren't kept."""
    lost = span_copies(spark, path, **k).select(F.col("copy_recv_no").alias("recv_no"))
    spans = spark.read.parquet(path).where(norm_id("trace_id").isNotNull() & norm_id("span_id").isNotNull())
    return spans.join(lost, "recv_no", "left_anti")


def stream_totals(spark: SparkSession, path: str, **k) -> DataFrame:
    """How a delivery went: n_messages, n_new, n_copies, and whether it took several
    micro-batches and some messages were settled by the late-arrival lookup."""
    root = run_spans(spark, path, **k)
    x = told(spark, root, "new").unionByName(told(spark, root))
    late = spark.read.schema(_OUT).parquet(f"{root}/late").count() if exists(spark, f"{root}/late") else 0
    one = F.lit(1)
    return x.agg(
        F.count(one).alias("n_messages"),
        F.count(F.when(F.col("kind") == "new", one)).alias("n_new"),
        F.count(F.when(F.col("kind") == "copy", one)).alias("n_copies"),
        (F.countDistinct("batch") > 1).alias("several_batches"),
        F.lit(late > 0).alias("some_late"),
    )
