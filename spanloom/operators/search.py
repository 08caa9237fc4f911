"""Span search, trace lookup and discovery."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from spanloom.operators.filters import Filters, split, where
from spanloom.sources.schema import TIES

LIMIT, OFFSET = 100, 0
#: Rows of start_time up to which a page's last row is found by the driver.
EDGE_ROWS = 10_000


@dataclass
class Result:
    entries: list[Row]
    total: int
    limit: int
    offset: int
    has_more: bool


def order_columns(spans: DataFrame, order: str = "desc") -> list[Column]:
    """start_time, then the other plain columns against ties."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order: {order}")
    first = F.col("start_time").desc() if order == "desc" else F.col("start_time").asc()
    return [first, *(F.col(c).asc() for c in TIES if c in spans.columns)]


def ordered(spans: DataFrame, order: str = "desc") -> DataFrame:
    """By start_time, ties by the other plain columns, so that pages never change."""
    return spans.orderBy(*order_columns(spans, order))


def page(spans: DataFrame, filters: Filters) -> DataFrame:
    """The rows of one page; a top-k per partition, no full sort."""
    p, conds = split(filters)
    return ordered(where(spans, conds), p.get("order", "desc")).offset(int(p.get("offset", OFFSET))).limit(int(p.get("limit", LIMIT)))


def page_after(spans: DataFrame, filters: Filters, last: Mapping[str, Any]) -> DataFrame:
    """The page that follows a row: limit spans behind `last` (its start_time and the
    columns that break ties) in the order. However deep, a page costs as much as the first;
    offset isn't used. Rows that are the same in all these columns count as one."""
    p, conds = split(filters)
    down = p.get("order", "desc") == "desc"
    rows = where(spans, conds)
    behind = F.lit(False)
    for c in reversed([c for c in TIES if c in spans.columns]):  # nulls come first
        col, v = F.col(c), last[c]
        after = col.isNotNull() if v is None else col > v
        behind = after | (col.eqNullSafe(F.lit(v)) & behind)
    t, v = F.col("start_time"), last["start_time"]
    same = t.eqNullSafe(F.lit(v).cast("long")) & behind
    if v is None:
        far = F.lit(False) if down else t.isNotNull()
    else:
        far = ((t < v) | t.isNull()) if down else t > v
    return ordered(rows.where(F.coalesce(far, F.lit(False)) | F.coalesce(same, F.lit(False))), p.get("order", "desc")).limit(int(p.get("limit", LIMIT)))


def page_meta(spans: DataFrame, filters: Filters) -> DataFrame:
    """total, limit, offset, has_more of a page. With count_total False the total
    is what a look at one row past the page tells."""
    p, conds = split(filters)
    limit, offset = int(p.get("limit", LIMIT)), int(p.get("offset", OFFSET))
    rows = where(spans, conds)
    if p.get("count_total", True):
        one = rows.agg(F.count(F.lit(1)).alias("total"))
        more = F.col("total") > offset + limit
    else:
        got = rows.select(F.lit(1)).limit(offset + limit + 1).agg(F.count(F.lit(1)).alias("n"))
        have = F.greatest(F.lit(0), F.least(F.col("n") - offset, F.lit(limit)))
        one = got.select((F.lit(offset) + have + (F.col("n") > offset + limit).cast("int")).cast("long").alias("total"), "n")
        more = F.col("n") > offset + limit
    return one.select("total", F.lit(limit).cast("long").alias("limit"), F.lit(offset).cast("long").alias("offset"), more.alias("has_more"))


def query(spans: DataFrame, filters: Filters, total: int | None = None) -> Result:
    """A page with its totals. total: the number of matches where it is known, so
    that spans may be only those that can be on the page.

    First a look at the condition's columns and start_time alone: how many spans
    match, and the start_time of the page's last row. Then the page itself, from
    the row groups that reach that time; only they are read with all columns.
    Spans without start_time come first in ascending order, last in descending.
    """
    p, conds = split(filters)
    limit, offset, order = int(p.get("limit", LIMIT)), int(p.get("offset", OFFSET)), p.get("order", "desc")
    exact, known = p.get("count_total", True), total
    need = offset + limit + (not exact)
    narrow = where(spans, conds).select("start_time")
    if need <= EDGE_ROWS:
        # the total is counted on the way to the page's last row
        seen = Observation() if exact and known is None else None
        got = ordered(narrow if seen is None else narrow.observe(seen, F.count(F.lit(1)).alias("n")), order).limit(max(1, need)).collect()[: max(0, need)]
        times = [r[0] for r in got if r[0] is not None]
        n, timed, edge_ = len(got), len(times), times[-1] if times else None
        total = known if known is not None else seen.get["n"] if exact else n
    else:
        last = ordered(narrow, order).limit(need)
        edge = F.min("start_time") if order == "desc" else F.max("start_time")
        got = last.agg(edge.alias("edge"), F.count(F.lit(1)).alias("n"), F.count("start_time").alias("timed"))
        if known is not None:
            got = got.withColumn("total", F.lit(known).cast("long"))
        elif exact:
            got = got.crossJoin(narrow.agg(F.count(F.lit(1)).alias("total")))  # one row each
        else:
            got = got.withColumn("total", F.least("n", F.lit(need)))
        r = got.select("edge", "n", "timed", "total").first()
        edge_, n, timed, total = r["edge"], r["n"], r["timed"], r["total"]
    if n <= offset or limit <= 0:
        rows = []
    else:
        t = F.col("start_time")
        part = F.lit(False) if edge_ is None else t >= edge_ if order == "desc" else t <= edge_
        if timed < n:  # the page reaches spans without start_time
            part = part | t.isNull()
        part = spans.where(part)
        rows = page(part, [*conds, ("order", order), ("offset", offset), ("limit", limit)]).collect()
    if exact:
        return Result(rows, total, limit, offset, total > offset + limit)
    more = n == need
    return Result(rows, offset + len(rows) + more, limit, offset, more)


def trace(spans: DataFrame, *trace_ids: str) -> DataFrame:
    """A trace's spans by start_time; none for an unknown trace."""
    return ordered(spans.where(F.col("trace_id").isin(*trace_ids)), "asc")


def services(spans: DataFrame) -> DataFrame:
    return spans.where("service_name is not null").select(F.col("service_name").alias("service")).distinct().orderBy("service")


def operations(spans: DataFrame, service: str) -> DataFrame:
    return spans.where(F.col("service_name") == service).select(F.col("name").alias("operation")).distinct().orderBy("operation")


def trace_summaries(spans: DataFrame) -> DataFrame:
    """Per trace: span_count, root_name (the earliest span without parent, else the
    earliest span), duration_ns (latest end minus earliest start), has_error."""
    first = F.struct(F.col("parent_span_id").isNotNull().cast("int").alias("child"), "start_time", "span_id", "name")
    return spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("span_count"),
        F.min_by("name", first).alias("root_name"),
        (F.max("end_time") - F.min("start_time")).alias("duration_ns"),
        F.max(F.col("status") == "error").alias("has_error"),
    )


def parent_edges(spans: DataFrame) -> DataFrame:
    """Child and parent; that the parent exists isn't checked."""
    return spans.where("parent_span_id is not null").select("trace_id", "span_id", "parent_span_id")
