"""Search conditions as columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources.schema import PROMOTED, SEARCH_TEXT, lookup, text

PAGE_KEYS = ("limit", "offset", "order", "count_total")
TERM_KEYS = ("name", "service", "kind", "status", "attributes")
TIME_KEYS = ("since", "until")
FILTER_KEYS = (*TERM_KEYS, *TIME_KEYS, "min_duration", "max_duration", "trace_id")

Filters = Mapping[str, Any] | Iterable[tuple[str, Any]]


def to_ns(t: int | dt.datetime) -> int:
    """Nanoseconds since 1970 of a number or a point in time (without zone: UTC)."""
    if isinstance(t, dt.datetime):
        t = t if t.tzinfo else t.replace(tzinfo=dt.UTC)
        d = t - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
        return (d.days * 86_400_000_000 + d.seconds * 1_000_000 + d.microseconds) * 1000
    return int(t)


def pairs(filters: Filters) -> list[tuple[str, Any]]:
    return list(filters.items()) if isinstance(filters, Mapping) else list(filters)


def split(filters: Filters) -> tuple[dict[str, Any], list[tuple[str, Any]]]:
    """Paging options and conditions. Of a repeated paging option the first counts."""
    page: dict[str, Any] = {}
    rest = []
    for k, v in pairs(filters):
        if k in PAGE_KEYS:
            page.setdefault(k, v)
        else:
            rest.append((k, v))
    return page, rest


def _name(pattern: str, columns: set[str]) -> Column:
    p = F.lit(pattern.lower())
    if SEARCH_TEXT in columns and "\0" not in pattern:
        return F.contains(F.col(SEARCH_TEXT), p)
    texts = F.exists(F.map_values("attributes"), lambda v: (F.schema_of_variant(v) == "STRING") & F.contains(F.lower(text(v)), p))
    return F.contains(F.lower(F.col("name")), p) | F.coalesce(texts, F.lit(False))


def _words(v: Any) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


def condition(key: str, value: Any, columns: Iterable[str]) -> Column | None:
    """One condition; unknown keys are None and hold for every span."""
    columns = set(columns)

    def attribute(k: str) -> Column:
        return F.col(PROMOTED[k]) if PROMOTED.get(k) in columns else lookup(k)

    match key:
        case "name":
            return _name(value, columns)
        case "service":
            return attribute("service.name") == value
        case "kind" | "status" | "trace_id":
            return F.col(key) == value
        case "min_duration":
            return F.col("duration_ns") >= int(value)
        case "max_duration":
            return F.col("duration_ns") <= int(value)
        case "since":
            return F.col("start_time") >= to_ns(value)
        case "until":
            return F.col("start_time") <= to_ns(value)
        case "attributes":
            cond = F.lit(True)
            for k, v in value.items():
                cond = cond & (attribute(k) == _words(v))
            return cond
    return None


def terms_of(conditions: Iterable[tuple[str, Any]]) -> list[str]:
    """Index terms that any span which meets the conditions makes its block have."""
    out = []
    for k, v in conditions:
        if k in ("kind", "status"):
            out.append(f"{k}:{v}")
        elif k == "service":
            out.append(f"service.name:{v}")
        elif k == "attributes":
            out += [f"{a}:{_words(x)}" for a, x in v.items() if a in PROMOTED]
    return out


def where(spans: DataFrame, filters: Filters) -> DataFrame:
    """Spans for which all conditions hold. No condition: all spans. A key may be
    repeated; keys that aren't conditions are ignored. Comparisons with null
    don't hold. Durations must have been filled (see from_raw), so that the
    bare columns reach the scan."""
    for k, v in pairs(filters):
        c = condition(k, v, spans.columns)
        if c is not None:
            spans = spans.where(c)
    return spans
