"""Identifiers: one spelling for comparison, and hexadecimal codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def norm_id(c: Column | str) -> Column:
    """Lower case without surrounding blanks; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(v != "", v)


def norm_parent(c: Column | str) -> Column:
    """Like norm_id; an identifier of zeros only also means no parent."""
    v = norm_id(c)
    return F.when(F.translate(v, "0", "") != "", v)


def floor_div(x: Column | str, by: int) -> Column:
    """Whole-number division that rounds down, also below zero, without doubles."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.lit(by).cast("long")
    return F.call_function("div", x - F.pmod(x, n), n)


def utc_day(ns: Column | str) -> Column:
    """YYYY-MM-DD of nanoseconds since 1970, whatever the session's time zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, 86_400_000_000_000).cast("int")), "yyyy-MM-dd")


def hex_id(c: Column | str, width: int) -> Column:
    """A whole number as lower-case hexadecimal digits, padded with zeros to width."""
    return F.lower(F.lpad(F.hex(c), width, "0"))


def trace_hex(c: Column | str) -> Column:
    return hex_id(c, 32)


def span_hex(c: Column | str) -> Column:
    return hex_id(c, 16)


def pack_id(c: Column | str) -> Column:
    """A trace id of 32 lower-case hexadecimal digits as 16 bytes; any other as its own bytes."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.unhex(c)).otherwise(F.encode(c, "utf-8"))


def binary_hex(c: Column | str) -> Column:
    """Bytes as lower-case hexadecimal digits; no bytes are ''."""
    return F.lower(F.hex(c))


def lookup_keys(trace_id: str | bytes | int) -> list[str]:
    """The spellings under which a trace may be stored: a number or 16 bytes as 32
    hexadecimal digits; text as it is."""
    if isinstance(trace_id, int):
        return [f"{trace_id:032x}"]
    if isinstance(trace_id, (bytes, bytearray)):
        plain = [bytes(trace_id).decode("utf-8", "ignore")]
        return [bytes(trace_id).hex()] if len(trace_id) == 16 else plain
    return [trace_id]
