"""A span store of Parquet blocks under a log of changes."""

from __future__ import annotations

import json
import random
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import EngineConfig
from spanloom.operators import blocks as B
from spanloom.operators.search import order_columns
from spanloom.sources.files import Files
from spanloom.sources.schema import COLUMNS, PROMOTED, RESOURCE_TERMS, SEARCH_TEXT, SPAN_SCHEMA, from_raw, promote

FULL_SCHEMA = SPAN_SCHEMA + "".join(f", {c} string" for c in [*PROMOTED.values(), *RESOURCE_TERMS.values(), SEARCH_TEXT])
MANIFEST = "block_id string, file_path string, byte_size bigint, entry_count bigint, ts_min bigint, ts_max bigint, block_format string, created_at timestamp, deleted_at timestamp, n_terms bigint"
#: Format of the log; a store written by a later one isn't opened.
VERSION = 2
#: Bytes of a row group before compression: small enough that time ranges and
#: trace ids rule most of them out, and that one file is read by several tasks.
ROW_GROUP_BYTES = 16 << 20
#: Compressed bytes and spans of one file that compaction aims at.
FILE_BYTES, FILE_SPANS = 128 << 20, 250_000
#: Changes between two checkpoints of the log.
CHECKPOINT_EVERY = 20
#: Bits of a block's signature of terms and bits that a term sets. A signature
#: with more than SIGNATURE_FULL bits rules nothing out and isn't kept.
SIGNATURE_BITS, TERM_BITS, SIGNATURE_FULL = 1024, 3, 700
#: Segments up to which a trace is looked up by the driver; beyond it by a job.
DIRECT_SEGMENTS = 32
#: Ranges of start_time that are told apart in the lookup of a trace.
MOST_RANGES = 64
#: Blocks of a trace up to this size are read by one task.
ONE_TASK_BYTES = 64 << 20
#: Rows of trace postings in one file.
POSTING_ROWS = 2_000_000

_STATE = pa.schema(
    [(c, pa.string()) for c in ("block_id", "file_path", "block_format", "segment", "source", "signature", "postings")]
    + [(c, pa.int64()) for c in ("byte_size", "entry_count", "ts_min", "ts_max", "created_us", "deleted_us", "n_terms")]
)
_COUNTERS = {"raw_in": 0, "compressed_out": 0, "compactions": 0}


class CorruptBlock(RuntimeError):
    pass


class Conflict(RuntimeError):
    """Blocks that a change is about have been replaced meanwhile."""


class UnknownVersion(RuntimeError):
    pass


def _signature_bits(terms: Column) -> Column:
    """Distinct bit numbers of an array of terms."""
    def bit(k: int) -> Column:
        return F.transform(terms, lambda t: F.shiftright(F.xxhash64(t), 10 * k).bitwiseAND(F.lit(SIGNATURE_BITS - 1)).cast("int"))

    return F.array_distinct(F.concat(*map(bit, range(TERM_BITS))))


def signature_of(terms: Iterable[str]) -> int:
    """The same bits of terms at hand."""
    hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in terms]
    out = 0
    for h in hashes:
        for k in range(TERM_BITS):
            out |= 1 << (h >> 10 * k & SIGNATURE_BITS - 1)
    return out


def _signature(bits: list[int]) -> str | None:
    return None if len(bits) > SIGNATURE_FULL else f"{sum(1 << b for b in bits):x}"


def _by_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df in partitions that follow each other by key, nulls in the first. The bounds
    come from the key's column alone: repartitionByRange goes through all columns twice."""
    shares = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * parts))).first()[0]
    bounds = sorted(set(bounds or []))
    if not bounds:
        return df.coalesce(1)
    at = F.array(*(F.lit(b).cast("long") for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.get(at, n + k - 1) < F.col(key), n + k).otherwise(n))  # bounds below the key
    return df.repartitionById(len(bounds) + 1, below)


class SpanStore:
    """Blocks below root/blocks, their terms and trace postings below root/index, and
    root/log: one small file per change, numbered without gaps.

    A change writes its files first and then the next number of the log, which
    succeeds for one writer only; the others read what has come in between, apply
    their change to it and try the number after. So an append that has returned is in the store
    whatever else went on. A version of the store is what the log says up to a
    number; a DataFrame that was opened stays on the version it was opened
    with, as replaced files stay until vacuum() finds them replaced for longer than
    vacuum_after_s. Every CHECKPOINT_EVERY changes the list of blocks is written
    as a table, from which later openings start.

    The driver holds one row per block (some hundred bytes), as it must for the
    list of files of any scan.
    """

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None, note: Callable[..., None] | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or EngineConfig()
        self.files = Files(spark, self.root)
        self.note = note or (lambda event, **what: None)
        self.version, self._t, self._count = 0, _STATE.empty_table(), dict(_COUNTERS)
        self._loaded, self._lock = False, threading.RLock()

    # --- the log

    def _log(self, n: int) -> str:
        return f"{self.root}/log/{n:020d}.json"

    def refresh(self) -> int:
        """Reads what the log has that isn't known yet; the current version's number."""
        with self._lock:  # threads share a store
            if not self._loaded:
                self._open()
            while (text := self.files.read(self._log(self.version + 1))) is not None:
                self._apply(text)
                self.version += 1
            return self.version

    def _open(self) -> None:
        hint = self.files.read(f"{self.root}/log/checkpoint")
        if hint:
            at = json.loads(hint)
            self._check(at["format"])
            rows = self.spark.read.parquet(f"{self.root}/{at['path']}").select(*_STATE.names).toArrow()
            self._t, self.version, self._count = rows.cast(_STATE), at["version"], at["counters"]
        elif self.files.exists(f"{self.root}/CURRENT") and not self.files.exists(self._log(1)):
            self._import_old()
        self._loaded = True

    @staticmethod
    def _check(version: int) -> None:
        if version > VERSION:
            raise UnknownVersion(f"log format {version}, known up to {VERSION}")

    def _import_old(self) -> None:
        """Takes over a store of log format 1 (one table per version of the list)."""
        cur = json.loads(self.files.read(f"{self.root}/CURRENT"))
        self._check(cur["version"])
        rows = []
        for r in self.spark.read.parquet(f"{self.root}/manifest/{cur['name']}").collect():
            rows.append({c: r[c] for c in ("block_id", "file_path", "block_format", "byte_size", "entry_count", "ts_min", "ts_max")} | {"created_us": int(r["created_at"].timestamp() * 1e6), "segment": r["file_path"].split("/")[1]})
        self.files.put_new(self._log(1), json.dumps({"format": VERSION, "add": rows, "remove": [], "forget": [], "counters": cur.get("counters") or {}, "us": time.time_ns() // 1000}))

    def _apply(self, text: str) -> None:
        e = json.loads(text)
        self._check(e["format"])
        t = self._t
        if e["remove"]:
            hit = pc.is_in(t["block_id"], pa.array(e["remove"]))
            t = t.set_column(t.schema.get_field_index("deleted_us"), "deleted_us", pc.if_else(pc.and_(hit, pc.is_null(t["deleted_us"])), pa.scalar(e["us"]), t["deleted_us"]))
        if e["forget"]:
            t = t.filter(pc.invert(pc.is_in(t["block_id"], pa.array(e["forget"]))))
        if e["add"]:
            t = pa.concat_tables([t, pa.Table.from_pylist(e["add"], _STATE)])
        self._t = t
        for k, v in e["counters"].items():
            self._count[k] = self._count.get(k, 0) + v

    def _commit(self, change: Callable[[pa.Table], dict | None]) -> bool:
        """Appends change(live blocks) to the log; on a lost race it is asked again.
        A change of None ends without one."""
        lost = 0
        while True:
            with self._lock:
                n, live = self.refresh() + 1, self.live()
            got = change(live)
            if got is None:
                return False
            entry = {"format": VERSION, "add": [], "remove": [], "forget": [], "counters": {}, "us": time.time_ns() // 1000} | got
            if self.files.put_new(self._log(n), json.dumps(entry)):
                self.refresh()
                if n % CHECKPOINT_EVERY == 0:
                    self.checkpoint()
                return True
            if not self.files.exists(self._log(n)):  # no other writer was faster
                lost += 1
                if lost > 10:
                    raise OSError(f"{self._log(n)} can't be written")
            time.sleep(random.uniform(0, 0.05))

    def checkpoint(self) -> None:
        with self._lock:
            t, n, counters = self._t, self.version, dict(self._count)
        path = f"log/{n:020d}-{uuid.uuid4().hex}.parquet"
        if not t.num_rows:
            return
        self.spark.createDataFrame(t.combine_chunks()).coalesce(1 + t.num_rows // 1_000_000).write.parquet(f"{self.root}/{path}")
        self.files.put(f"{self.root}/log/checkpoint", json.dumps({"format": VERSION, "version": n, "path": path, "counters": counters}))

    # --- what there is

    def live(self) -> pa.Table:
        return self._t.filter(pc.is_null(self._t["deleted_us"]))

    def manifest(self) -> DataFrame:
        """The blocks of the current version."""
        self.refresh()
        return self._frame(self.live())

    def _frame(self, t: pa.Table) -> DataFrame:
        if not t.num_rows:
            return self.spark.createDataFrame([], MANIFEST)
        at = {c: pc.cast(t[c + "_us"], pa.timestamp("us", "UTC")) for c in ("created", "deleted")}
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        cols = [at[c.removesuffix("_at")] if c.endswith("_at") else t[c] for c in names]
        return self.spark.createDataFrame(pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names), MANIFEST)

    def counters(self) -> dict[str, int]:
        self.refresh()
        return dict(self._count)

    def stats(self) -> DataFrame:
        return B.stats_by_format(self.manifest())

    def pruned(self, since: int | None = None, until: int | None = None, terms: Sequence[str] = ()) -> pa.Table:
        """Blocks that can hold spans of the time range with all of the terms. Blocks
        with a span that has no start_time at all have no range and stay."""
        self.refresh()
        t = self.live()
        for col, bound, test in (("ts_max", since, pc.greater_equal), ("ts_min", until, pc.less_equal)):
            if bound is not None:
                t = t.filter(pc.fill_null(test(t[col], bound), False))
        if terms and t.num_rows:
            want = signature_of(terms)
            t = t.filter(pa.array([s is None or int(s, 16) & want == want for s in t["signature"].to_pylist()], pa.bool_()))
        return t

    # --- writing

    def _write(self, spans: DataFrame, fmt: str, source: str | None = None) -> list[dict]:
        """Writes spans as files of a new segment, one block per file, then, from the
        few columns that they ask for, the blocks' ranges, terms and trace postings."""
        segment = f"{fmt}-{uuid.uuid4().hex}"
        folder = f"{self.root}/blocks/{segment}"
        w = spans.write.option("parquet.block.size", str(ROW_GROUP_BYTES))
        if fmt == "raw":
            w = w.option("compression", "snappy")
        else:
            w = w.option("compression", self.config.compression)
            if self.config.compression == "zstd":
                w = w.option("parquet.compression.codec.zstd.level", str(self.config.compression_level))
        w.parquet(folder)
        m = F.col("_metadata")
        keyed = self.spark.read.schema(FULL_SCHEMA).parquet(folder).withColumn("block_id", F.concat(F.lit(f"{segment}/"), m["file_name"]))
        index = f"{self.root}/index/{segment}"
        one = F.lit(1)

        def ranges() -> list:
            sets, terms = B.term_sets(keyed.columns)
            got = keyed.groupBy("block_id", m["file_size"].alias("byte_size")).agg(F.count(one).alias("entry_count"), F.min("start_time").alias("ts_min"), F.max("start_time").alias("ts_max"), *sets)
            got.select("block_id", "byte_size", "entry_count", "ts_min", "ts_max", terms.alias("terms")).write.parquet(f"{index}/terms")
            r = self.spark.read.parquet(f"{index}/terms")
            return r.select("block_id", "byte_size", "entry_count", "ts_min", "ts_max", F.size("terms").alias("n_terms"), _signature_bits(F.col("terms")).alias("bits")).collect()

        def postings() -> None:
            there = [(n, size) for n, size, _ in self.files.listing(folder) if n.startswith("part-")]
            parts = 1 + sum(size for _, size in there) // (POSTING_ROWS * 32)
            # blocks go through shuffles and sorting by a hash of their name, which takes an eighth of its bytes;
            # two names of one hash would only name a block too many
            names = self.spark.createDataFrame(pa.table({"name": pa.array([n for n, _ in there], pa.string())}))
            names = names.select(F.concat(F.lit(f"{segment}/"), "name").alias("block_id"), F.xxhash64("name").alias("no"))
            got = keyed.where("trace_id is not null").groupBy("trace_id", F.xxhash64(m["file_name"]).alias("no"))
            got = got.agg(F.min("start_time").alias("lo"), F.max("start_time").alias("hi"), F.count_if(F.col("start_time").isNull()).alias("untimed"))
            # a lookup opens each file anyway, so they needn't be ranges of traces, which took another shuffle
            got = got.coalesce(parts).sortWithinPartitions("trace_id", "no")
            got = got.join(F.broadcast(names), "no").select("trace_id", "block_id", "lo", "hi", "untimed")  # one short row per block
            got.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{index}/traces")

        with ThreadPoolExecutor(2) as pool:
            rows, _ = (f.result() for f in (pool.submit(ranges), pool.submit(postings)))
        rows = [r for r in rows if r["entry_count"]]
        if not rows:
            self._drop([segment])
            return []
        lists = ",".join(sorted(n for n, _, _ in self.files.listing(f"{index}/traces") if n.startswith("part-")))
        now = time.time_ns() // 1000
        return [
            {c: r[c] for c in ("block_id", "byte_size", "entry_count", "ts_min", "ts_max", "n_terms")}
            | {"file_path": f"blocks/{r['block_id']}", "block_format": fmt, "segment": segment, "source": source, "signature": _signature(r["bits"]), "postings": lists, "created_us": now}
            for r in rows
        ]

    def _drop(self, segments: Sequence[str]) -> None:
        self.files.delete(f"{self.root}/{kind}/{s}" for s in segments for kind in ("blocks", "index"))

    def append(self, spans: DataFrame, name: str | None = None, fmt: str = "raw") -> int:
        """Adds spans (any columns, see from_raw) as new blocks; repeated spans stay.
        With name, blocks of that name are replaced: repeating an append is safe."""
        new = self._write(promote(from_raw(spans)), fmt, name)

        def change(live: pa.Table) -> dict | None:
            old = live.filter(pc.equal(live["source"], name))["block_id"].to_pylist() if name else []
            return {"add": new, "remove": old} if new or old else None

        self._commit(change)
        return sum(r["entry_count"] for r in new)

    # --- reading

    def _read(self, t: pa.Table, strict: bool = False) -> DataFrame:
        """Spans of the blocks in t. A block whose file is gone is told, taken out of the
        list and left out; a corrupt one is left out (see verify)."""
        paths = [f"{self.root}/{p}" for p in t["file_path"].to_pylist()]
        if not paths:
            return self.spark.createDataFrame([], FULL_SCHEMA)
        r = self.spark.read.schema(FULL_SCHEMA)
        if strict:
            return r.parquet(*paths)
        r = r.option("ignoreCorruptFiles", "true")
        try:
            return r.parquet(*paths)
        except AnalysisException:  # a file is gone: only now each is looked up
            lost = set(self.files.missing(paths))
            keep = pa.array([p not in lost for p in paths])
            self._lost(t.filter(pc.invert(keep)))
            return self._read(t.filter(keep))

    def _lost(self, t: pa.Table) -> int:
        """Takes blocks without files out of the list."""
        ids = t["block_id"].to_pylist()
        for b, p in zip(ids, t["file_path"].to_pylist(), strict=True):
            self.note("block.missing", block_id=b, file_path=p)
        return self._remove_ids(ids)

    def _remove_ids(self, ids: list[str]) -> int:
        n = 0

        def change(live: pa.Table) -> dict | None:
            nonlocal n
            there = live.filter(pc.is_in(live["block_id"], pa.array(ids, pa.string())))["block_id"].to_pylist()
            n = len(there)
            return {"remove": there} if there else None

        self._commit(change)
        return n

    def spans(self, since: int | None = None, until: int | None = None, terms: Sequence[str] = ()) -> DataFrame:
        """Spans of all blocks that can meet the time range and hold all terms; the
        conditions themselves aren't applied."""
        return self._read(self.narrowed(self.pruned(since, until, terms), terms))

    def narrowed(self, t: pa.Table, terms: Sequence[str]) -> pa.Table:
        """Where many blocks are left, those whose terms the index has, too."""
        if not terms or t.num_rows <= 2 * DIRECT_SEGMENTS:
            return t
        ids = B.holding(self._terms(t), terms).select("block_id").toArrow()["block_id"]
        known = pc.is_null(t["postings"])  # blocks taken over without an index stay
        return t.filter(pc.or_(known, pc.is_in(t["block_id"], ids)))

    def block_spans(self, block_ids: Sequence[str]) -> DataFrame:
        """Spans of chosen blocks."""
        self.refresh()
        t = self.live()
        return self._read(t.filter(pc.is_in(t["block_id"], pa.array(list(block_ids), pa.string()))))

    def newest_first(self) -> Iterator[tuple[pa.Table, int | None]]:
        """Growing sets of blocks, the newest first, each with the latest start_time
        that a span of any other block can have (None: there is no other)."""
        self.refresh()
        t = self.live().sort_by([("ts_max", "descending")])
        yield from self.growing(t)

    @staticmethod
    def growing(t: pa.Table, first: int = 4) -> Iterator[tuple[pa.Table, int | None]]:
        """See newest_first; t: blocks, the newest first."""
        n = first
        while n < t.num_rows:
            yield t.slice(0, n), t["ts_max"][n].as_py()
            n *= 4
        yield t, None

    def newest(self, limit: int, offset: int = 0) -> DataFrame:
        """Spans of the blocks that can hold the newest offset + limit ones."""
        return self._read(self.newest_blocks(offset + limit))

    def newest_blocks(self, need: int, since: int | None = None, until: int | None = None) -> pa.Table:
        """Blocks that can hold the newest `need` spans. Only blocks that lie whole in the
        time range are sure to give all their spans."""
        t = self.pruned(since, until).sort_by([("ts_max", "descending")])
        got, floor = 0, None
        for lo, hi, k in zip(t["ts_min"].to_pylist(), t["ts_max"].to_pylist(), t["entry_count"].to_pylist(), strict=True):
            if lo is None or (since is not None and lo < since) or (until is not None and hi > until):
                continue
            got += k
            floor = lo if floor is None else min(floor, lo)
            if got >= need:
                return t.filter(pc.fill_null(pc.greater_equal(t["ts_max"], floor), False))
        return t

    def matching_block_ids(self, terms: Sequence[str] = (), since: int | None = None, until: int | None = None, order: str = "asc") -> list[str]:
        """Blocks that hold all terms and meet the time range, by ts_min; from the index, no span is read."""
        t = self.pruned(since, until, terms)
        if terms and t.num_rows:
            t = t.filter(pc.is_in(t["block_id"], B.holding(self._terms(t), terms).select("block_id").toArrow()["block_id"]))
        return t.sort_by([("ts_min", "ascending" if order == "asc" else "descending"), ("block_id", "ascending")])["block_id"].to_pylist()

    # --- the index

    def _terms(self, t: pa.Table) -> DataFrame:
        """block_id and terms of the blocks in t. Segments are read whole, so rows of blocks
        that are no longer in the list are taken out."""
        segments = pc.unique(t.filter(pc.is_valid(t["postings"]))["segment"]).to_pylist()
        if not segments:
            return self.spark.createDataFrame([], "block_id string, terms array<string>")
        r = self.spark.read.schema("block_id string, terms array<string>").parquet(*(f"{self.root}/index/{s}/terms" for s in segments))
        return r.join(F.broadcast(self.spark.createDataFrame(t.select(["block_id"]).combine_chunks())), "block_id", "left_semi")  # one short row per block

    def term_index(self) -> DataFrame:
        """(term, block_id) of the current version, as written with the blocks."""
        self.refresh()
        return self._terms(self.live()).select("block_id", F.explode("terms").alias("term"))

    def services(self) -> DataFrame:
        """Distinct services, from the index."""
        return B.term_values(self.term_index(), "service.name").select(F.col("value").alias("service")).distinct().orderBy("service")

    def postings(self, keys: Sequence[str]) -> tuple[pa.Table, list[tuple[int | None, int | None, int]] | None]:
        """Blocks with spans of the traces called keys, and in which ranges of start_time
        these spans lie (first, last, number of spans without start_time), by what was
        written with the blocks. Blocks that came without postings are always among
        them; then there are no ranges."""
        self.refresh()
        t = self.live()
        lists = {}
        for s, p in zip(t["segment"].to_pylist(), t["postings"].to_pylist(), strict=True):
            if p is not None:
                lists[s] = p
        files = [f"{self.root}/index/{s}/traces/{n}" for s, p in lists.items() for n in p.split(",") if n]
        if not files:
            found = []
        elif len(files) <= DIRECT_SEGMENTS:
            found = [x for f in files for k in keys for x in self._look_up(f, k)]
        else:
            r = self.spark.read.schema("trace_id string, block_id string, lo bigint, hi bigint, untimed bigint").parquet(*files)
            found = [tuple(x) for x in r.where(F.col("trace_id").isin(list(keys))).select("block_id", "lo", "hi", "untimed").collect()]
        ids = pa.array(sorted({x[0] for x in found}), pa.string())
        t = t.filter(pc.or_(pc.is_null(t["postings"]), pc.is_in(t["block_id"], ids)))
        return t, None if t["postings"].null_count else [x[1:] for x in found]

    def trace_blocks(self, keys: Sequence[str]) -> pa.Table:
        return self.postings(keys)[0]

    def _look_up(self, path: str, key: str) -> list[tuple]:
        """Postings of one trace in one file: its footer and the pages that can hold the key."""
        q = self.spark.sparkContext._jvm.org.apache.parquet
        eq = q.filter2.predicate.FilterApi.eq(q.filter2.predicate.FilterApi.binaryColumn("trace_id"), q.io.api.Binary.fromString(key))
        b = q.hadoop.ParquetReader.builder(q.hadoop.example.GroupReadSupport(), self.files.path(path))
        r = b.withConf(self.spark.sparkContext._jsc.hadoopConfiguration()).withFilter(q.filter2.compat.FilterCompat.get(eq)).build()
        try:
            out = []
            while (g := r.read()) is not None:
                lo, hi = ((g.getLong(c, 0) if g.getFieldRepetitionCount(c) else None) for c in ("lo", "hi"))
                out.append((g.getString("block_id", 0), lo, hi, g.getLong("untimed", 0)))
            return out
        finally:
            r.close()

    def trace(self, keys: Sequence[str]) -> DataFrame:
        """Spans of the traces called keys by start_time, from the pages of their blocks that
        the postings' ranges of start_time leave. Blocks are sorted by it."""
        t, ranges = self.postings(keys)
        got = self._read(t).where(F.col("trace_id").isin(list(keys)))
        if ranges:
            at = F.col("start_time")
            timed = [(a, b) for a, b, _ in ranges if a is not None]
            if len(timed) > MOST_RANGES:
                timed = [(min(a for a, _ in timed), max(b for _, b in timed))]
            cond = F.lit(False)
            for a, b in timed:
                cond = cond | at.between(a, b)
            got = got.where(cond | at.isNull() if any(n for *_, n in ranges) else cond)
        by = order_columns(got, "asc")
        few = (pc.sum(t["byte_size"]).as_py() or 0) <= ONE_TASK_BYTES
        return got.coalesce(1).sortWithinPartitions(*by) if few else got.orderBy(*by)  # one task sorts without a shuffle

    # --- maintenance

    def _rewrite(self, t: pa.Table, fmt: str) -> None:
        """Replaces blocks by one sorted segment; unreadable blocks abort the change, and so
        do blocks that another writer has replaced."""
        ids = t["block_id"].to_pylist()
        want, size = pc.sum(t["entry_count"]).as_py(), pc.sum(t["byte_size"]).as_py()
        parts = max(-(-size // FILE_BYTES), -(-want // FILE_SPANS), 1)
        new: list[dict] = []
        try:
            src = self._read(t, strict=True)
            src = _by_ranges(src, "start_time", parts) if parts > 1 else src.coalesce(1)
            new = self._write(src.sortWithinPartitions("start_time"), fmt)
        except Exception as e:
            raise CorruptBlock(str(e)[:200]) from e
        segments = sorted({r["segment"] for r in new})
        got = sum(r["entry_count"] for r in new)
        if got != want:
            self._drop(segments)
            raise CorruptBlock(f"{got} of {want} spans could be read")
        out = sum(r["byte_size"] for r in new)

        def change(live: pa.Table) -> dict:
            if pc.sum(pc.is_in(live["block_id"], pa.array(ids))).as_py() != len(ids):
                self._drop(segments)
                raise Conflict("blocks were replaced meanwhile")
            return {"add": new, "remove": ids, "counters": {"raw_in": size, "compressed_out": out, "compactions": 1}}

        self._commit(change)

    def compact(self, force: bool = False) -> str:
        """Rewrites raw blocks sorted and compressed, if there are enough entries or
        the oldest block has waited long enough."""
        self.refresh()
        t = self.live()
        t = t.filter(pc.equal(t["block_format"], "raw")).sort_by([("ts_min", "ascending"), ("block_id", "ascending")])
        if not t.num_rows:
            return "noop"
        age = time.time() - pc.min(t["created_us"]).as_py() / 1e6
        if not force and pc.sum(t["entry_count"]).as_py() < self.config.compaction_threshold and age < self.config.compaction_max_raw_age_s:
            return "noop"
        try:
            self._rewrite(t, self.config.compression)
        except Conflict:
            return "noop"  # another writer was faster
        return "ok"

    def merge(self) -> str:
        """Merges small compressed blocks in batches (see merge_plan)."""
        c = self.config
        self.refresh()
        t = self.live()
        t = t.filter(pc.and_(pc.not_equal(t["block_format"], "raw"), pc.less(t["entry_count"], c.merge_target))).sort_by([("ts_min", "ascending"), ("block_id", "ascending")])
        plan = B.merge_plan(list(zip(t["block_id"].to_pylist(), t["entry_count"].to_pylist(), strict=True)), c.merge_target, c.merge_min_blocks)
        done = 0
        for batch in plan:
            try:
                self._rewrite(t.filter(pc.is_in(t["block_id"], pa.array(batch))), c.compression)
                done += 1
            except (CorruptBlock, Conflict) as e:
                self.note("block.error", blocks=len(batch), error=str(e))
        return "ok" if done else "noop"

    def delete(self, gone: DataFrame) -> int:
        """Takes blocks out of the list; vacuum() removes their files later."""
        return self._remove_ids(gone.select("block_id").toArrow()["block_id"].to_pylist())

    def delete_before(self, cutoff_ns: int) -> int:
        return self.delete(B.expired_by_age(self.manifest(), cutoff_ns))

    def retain(self, now_ns: int | None = None) -> dict[str, int] | str:
        """Deletes by age, then size, then number of terms."""
        c = self.config
        if c.retention_max_age_s is None and c.retention_max_bytes is None and c.retention_max_terms is None:
            return "noop"
        out = {"age": 0, "size": 0, "terms": 0}
        if c.retention_max_age_s is not None:
            out["age"] = self.delete_before((time.time_ns() if now_ns is None else now_ns) - c.retention_max_age_s * 1_000_000_000)
        if c.retention_max_bytes is not None:
            out["size"] = self.delete(B.expired_by_size(self.manifest(), c.retention_max_bytes))
        if c.retention_max_terms is not None:
            out["terms"] = self.delete(B.expired_by_weight(self.manifest().withColumn("n_terms", F.coalesce("n_terms", F.lit(0))), "n_terms", c.retention_max_terms))
        return out

    def vacuum(self, older_than_s: float | None = None) -> int:
        """Removes the files of blocks that were replaced or deleted more than
        older_than_s (vacuum_after_s) ago, and segments of that age that no change has
        taken up. A reader of a version older than that fails; it doesn't lose rows."""
        keep_s = self.config.vacuum_after_s if older_than_s is None else older_than_s
        self.refresh()
        limit = int((time.time() - keep_s) * 1e6)
        t = self._t
        old = t.filter(pc.fill_null(pc.less_equal(t["deleted_us"], limit), False))
        known, dead = set(pc.unique(t["segment"]).to_pylist()), set(pc.unique(old["segment"]).to_pylist())
        dead -= set(pc.unique(t.filter(pc.invert(pc.is_in(t["block_id"], old["block_id"])))["segment"]).to_pylist())
        self.files.delete(f"{self.root}/{p}" for p in old["file_path"].to_pylist())
        stray = [n for n, _, ms in self.files.listing(f"{self.root}/blocks") if n not in known and ms * 1000 <= limit]
        self._drop([*dead, *stray])
        ids = old["block_id"].to_pylist()
        if ids:
            self._commit(lambda live: {"forget": ids})
        return len(ids)

    def reconcile(self) -> int:
        """Takes blocks whose file is gone out of the list, by one listing of the folder."""
        self.refresh()
        t = self.live()
        folder = f"{self.root}/blocks"
        if not t.num_rows or not self.files.exists(folder):
            return self._lost(t) if t.num_rows else 0
        there = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
        there = there.select(F.regexp_extract("path", "(blocks/[^/]+/[^/]+)$", 1).alias("file_path"))
        lost = self._frame(t).join(there, "file_path", "left_anti").select("block_id").toArrow()["block_id"]
        return self._lost(t.filter(pc.is_in(t["block_id"], lost)))

    def verify(self) -> list[tuple[str, int, int]]:
        """Reads every block's narrowest column; (block_id, spans listed, spans read) of
        blocks that can't be read whole, each told as an event."""
        self.refresh()
        t = self.live()
        m = F.col("_metadata")
        got = self._read(t).groupBy(F.regexp_extract(m["file_path"], "blocks/([^/]+/[^/]+)$", 1).alias("block_id")).agg(F.count("duration_ns").alias("n"))
        bad = self._frame(t).join(got, "block_id", "left").where("entry_count <> coalesce(n, 0)").select("block_id", "entry_count", F.coalesce("n", F.lit(0)).alias("n")).collect()
        for r in bad:
            self.note("block.error", block_id=r["block_id"], listed=r["entry_count"], read=r["n"])
        return [tuple(r) for r in bad]

    def backup(self, target: str) -> dict[str, Any]:
        """Copies the files of the current version as tasks; the copy is a store."""
        target = target.rstrip("/")
        self.refresh()
        t = self.live()
        paths = t["file_path"].to_pylist()
        for s, p in {s: p for s, p in zip(t["segment"].to_pylist(), t["postings"].to_pylist(), strict=True) if p is not None}.items():
            paths += [f"index/{s}/traces/{n}" for n in p.split(",") if n]
            paths += [f"index/{s}/terms/{n}" for n, _, _ in self.files.listing(f"{self.root}/index/{s}/terms") if n.startswith("part-")]
        to = Files(self.spark, target)
        src, dst = (f"{f.fs.getUri().toString().removeprefix('file:///')}" for f in (self.files, to))
        pairs = [(f"{src}{self.files.plain(f'{self.root}/{p}')}", f"{dst}{to.plain(f'{target}/{p}')}") for p in paths]

        def copy(batches):
            from pyarrow import fs

            for b in batches:
                for x, y in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                    (a, p), (c, q) = fs.FileSystem.from_uri(x), fs.FileSystem.from_uri(y)
                    c.create_dir(q.rsplit("/", 1)[0], recursive=True)
                    fs.copy_files(p, q, source_filesystem=a, destination_filesystem=c, use_threads=False)
                yield b

        if pairs:
            self.spark.createDataFrame(pairs, "src string, dst string").repartition(min(len(pairs), 1000)).mapInArrow(copy, "src string, dst string").write.format("noop").mode("overwrite").save()
        rows = t.to_pylist()
        there = SpanStore(self.spark, target, self.config)
        there._commit(lambda live: {"add": rows, "remove": live["block_id"].to_pylist(), "counters": {k: v - there._count.get(k, 0) for k, v in self._count.items()}})
        return {"path": target, "files": t["file_path"].to_pylist(), "total_bytes": pc.sum(t["byte_size"]).as_py() or 0}


__all__ = ["COLUMNS", "Conflict", "CorruptBlock", "SpanStore", "UnknownVersion"]
