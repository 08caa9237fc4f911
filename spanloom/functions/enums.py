"""One spelling for names, kinds and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the trace format.
KINDS = ["internal", "server", "client", "producer", "consumer"]
STATUSES = ["ok", "error", "unset"]


def _enum(c: Column | str, prefix: str, known: list[str], default: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    v = F.regexp_replace(F.lower(F.trim(c)), f"^{prefix}", "")
    return F.when(c.isin(known), c).when(v.isin(known), v).otherwise(F.lit(default))  # most are spelt as they should be


def norm_kind(c: Column | str) -> Column:
    """server for Server or SPAN_KIND_SERVER; anything unknown or null is internal."""
    return _enum(c, "span_kind_", KINDS, "internal")


def norm_status(c: Column | str) -> Column:
    """error for ERROR or STATUS_CODE_ERROR; anything unknown or null is unset."""
    return _enum(c, "status_code_", STATUSES, "unset")


def norm_name(c: Column | str) -> Column:
    """Operation name: blanks trimmed and folded, numbers as path segments
    written {id}; null is ''."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.regexp_replace(F.trim(c), "\\s+", " ")
    return F.coalesce(F.regexp_replace(v, "/\\d+(?=/|$)", "/{id}"), F.lit(""))


def _code(c: Column | str, known: list[str], default: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), c), F.lit(0)) - 1, F.lit(default)).cast("tinyint")


def kind_code(c: Column | str) -> Column:
    """A kind as its place in KINDS; an unknown one or null is that of internal."""
    return _code(c, KINDS, 0)


def status_code(c: Column | str) -> Column:
    """A status as its place in STATUSES; an unknown one or null is that of unset."""
    return _code(c, STATUSES, 2)


def _named(c: Column | str, known: list[str], default: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, known)), F.col(c) if isinstance(c, str) else c), F.lit(default))


def kind_name(c: Column | str) -> Column:
    return _named(c, KINDS, "internal")


def status_name(c: Column | str) -> Column:
    return _named(c, STATUSES, "unset")
