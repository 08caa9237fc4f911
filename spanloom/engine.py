"""The library's front: one store with search, discovery and maintenance."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from spanloom.config import EngineConfig
from spanloom.functions.ids import lookup_keys
from spanloom.operators import search as S
from spanloom.operators.filters import Filters, pairs, split, terms_of, to_ns
from spanloom.runtime import work_path
from spanloom.sources.otlp import decode_json, decode_protobuf
from spanloom.sources.store import SpanStore
from spanloom.streaming.buffer import Buffer
from spanloom.streaming.ingest import shard


class Engine:
    """A store in config.data_dir or root. Use it as it is, or start() it for flushing,
    compaction, merging and retention in the background until stop()."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self.spark = spark
        self.events: list[tuple[str, dict]] = []
        self.memory = self.config.storage == "memory"
        where = work_path(spark, "memory") if self.memory else root or self.config.data_dir
        self.store = SpanStore(spark, where, self.config, self._note)
        self._cached: tuple[int, DataFrame] | None = None
        self._buffer = Buffer(self._write, self.config.max_buffer_spans, self.config.flush_interval_s)
        self._halt, self._thread = threading.Event(), None

    def _note(self, event: str, **what) -> None:
        self.events.append((event, what))
        del self.events[:-1000]

    # --- ingest

    def ingest(self, spans: DataFrame) -> int:
        """Spans of a DataFrame, in one change; they are there when it returns."""
        t = time.perf_counter()
        try:
            n = self.store.append(spans)
        except Exception as e:
            self._note("flush.error", error=str(e)[:200])
            raise
        self._note("flush.stop", entry_count=n, seconds=time.perf_counter() - t)
        return n

    def accept(self, body: bytes, protobuf: bool, spans: int) -> None:
        """A request's body into the buffer; it is there after the next flush."""
        self._buffer.add((body, protobuf), spans)

    def _write(self, items: list) -> None:
        got = None
        for binary in (False, True):
            some = [(bytearray(b) if binary else b.decode(),) for b, p in items if p is binary]
            if some:
                one = self.spark.createDataFrame(some, f"body {'binary' if binary else 'string'}")
                one = decode_protobuf(one) if binary else decode_json(one)
                got = one if got is None else got.unionByName(one)
        n = self.config.buffer_shards
        self.ingest(shard(got, n).repartition(n, "shard") if n > 1 else got)

    def flush(self) -> None:
        """Waits until all that was accepted is in the store."""
        self._buffer.flush()

    # --- search

    def _spans(self, filters: Filters) -> DataFrame:
        """Spans of the blocks that can meet the conditions."""
        if self.memory:
            return self._held()
        f = pairs(filters)
        since = max((to_ns(v) for k, v in f if k == "since"), default=None)
        until = min((to_ns(v) for k, v in f if k == "until"), default=None)
        return self.store.spans(since, until, terms_of(f))

    def _held(self) -> DataFrame:
        """All spans, cached by version."""
        v = self.store.refresh()
        if self._cached is None or self._cached[0] != v:
            if self._cached is not None:
                self._cached[1].unpersist()
            self._cached = (v, self.store.spans().persist(StorageLevel.MEMORY_AND_DISK))
        return self._cached[1]

    def query(self, filters: Filters = ()) -> S.Result:
        t = time.perf_counter()
        r = self._timed(lambda: self._query(filters))
        self._note("query.stop", total=r.total, seconds=time.perf_counter() - t)
        return r

    def _timed(self, run: Callable):
        """run, whose jobs are stopped after query_timeout_s."""
        if self.config.query_timeout_s is None:
            return run()
        sc, tag = self.spark.sparkContext, f"query-{time.time_ns()}"
        sc.addJobTag(tag)
        stop = threading.Timer(self.config.query_timeout_s, lambda: sc.cancelJobsWithTag(tag))
        stop.daemon = True
        stop.start()
        try:
            return run()
        finally:
            stop.cancel()
            sc.removeJobTag(tag)

    def _query(self, filters: Filters) -> S.Result:
        p, conds = split(filters)
        limit, offset = int(p.get("limit", S.LIMIT)), int(p.get("offset", S.OFFSET))
        newest = p.get("order", "desc") == "desc" and limit > 0 and not self.memory
        if newest and not conds and p.get("count_total", True):
            # the list of blocks knows the total, and which blocks hold the page
            t = self.store.newest_blocks(offset + limit)
            return S.query(self.store._read(t), filters, pc.sum(self.store.live()["entry_count"]).as_py() or 0)
        if newest and not p.get("count_total", True):
            return self._early(filters, conds)
        return S.query(self._spans(filters), filters)

    def _early(self, filters: Filters, conds: list) -> S.Result:
        """Newest blocks first; ends as soon as no other block can change the page."""
        since = max((to_ns(v) for k, v in conds if k == "since"), default=None)
        until = min((to_ns(v) for k, v in conds if k == "until"), default=None)
        terms = terms_of(conds)
        t = self.store.narrowed(self.store.pruned(since, until, terms), terms).sort_by([("ts_max", "descending")])
        for some, rest in self.store.growing(t):
            r = S.query(self.store._read(some), filters)
            if rest is None or (r.has_more and r.entries and r.entries[-1]["start_time"] is not None and r.entries[-1]["start_time"] > rest):
                return r
        raise AssertionError

    def trace(self, trace_id: str | bytes | int) -> DataFrame:
        """A trace's spans, from the blocks that its postings name."""
        keys = lookup_keys(trace_id)
        return S.trace(self._held(), *keys) if self.memory else self.store.trace(keys)

    def services(self) -> list[str]:
        return [r[0] for r in self.store.services().collect()]

    def operations(self, service: str) -> list[str]:
        return [r[0] for r in S.operations(self._spans({"service": service}), service).collect()]

    def stats(self) -> dict:
        rows = {r["block_format"]: r.asDict() for r in self.store.stats().collect()}
        total = rows.pop("*", None) or {}
        return {"total_blocks": total.get("n_blocks") or 0, "total_entries": total.get("n_entries") or 0, "total_bytes": total.get("n_bytes") or 0, "oldest": total.get("ts_min"), "newest": total.get("ts_max"), "formats": rows, **self.store.counters()}

    # --- maintenance

    def compact(self) -> str:
        t = time.perf_counter()
        out = self.store.compact()
        self._note("compaction.stop", result=out, seconds=time.perf_counter() - t)
        return out

    def merge(self) -> str:
        out = self.store.merge()
        self._note("merge.stop", result=out)
        return out

    def retain(self) -> dict | str:
        out = self.store.retain()
        self._note("retention.stop", result=out)
        if isinstance(out, dict) and out["terms"]:
            self._note("retention.term_pressure", blocks=out["terms"])
        return out

    def backup(self, target: str) -> dict:
        self.flush()
        return self.store.backup(target)

    def start(self) -> Engine:
        """Compacts and merges every compaction_interval_s, twice as long after each time
        there was nothing to do (up to compaction_backoff_cap_s); retains and vacuums every retention_interval_s."""
        if self._thread is None:
            self._halt.clear()
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()
        return self

    def _run(self) -> None:
        c = self.config
        wait, at_compact, at_retain = c.compaction_interval_s, time.monotonic() + c.compaction_interval_s, time.monotonic() + c.retention_interval_s
        while not self._halt.wait(max(0.0, min(at_compact, at_retain) - time.monotonic())):
            now = time.monotonic()
            try:
                if now >= at_compact:
                    idle = self.compact() == "noop" and self.merge() == "noop"
                    wait = min(2 * wait, c.compaction_backoff_cap_s) if idle else c.compaction_interval_s
                    at_compact = time.monotonic() + wait
                if now >= at_retain:
                    self.retain()
                    self.store.vacuum()
                    at_retain = time.monotonic() + c.retention_interval_s
            except Exception as e:  # told; the next round tries again
                self._note("block.error", error=str(e)[:200])
                at_compact, at_retain = max(at_compact, time.monotonic() + c.compaction_interval_s), max(at_retain, time.monotonic() + c.compaction_interval_s)

    def stop(self) -> None:
        """Ends the background work and drains the buffer."""
        self._halt.set()
        if self._thread is not None:
            self._thread.join()
            self._thread = None
        self.flush()
