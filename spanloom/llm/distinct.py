"""Distinct counts over huge identifier sets from mergeable registers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that choose a register: 2 ** BITS registers, standard error 1.04 / sqrt(2 ** BITS).
BITS = 12


def standard_error(bits: int = BITS) -> float:
    return 1.04 / float(np.sqrt(2**bits))


def _leading(h: Column, bits: int) -> Column:
    """1 + leading zeros of the 64 - bits lower bits of a hash; built of shifts
    that fill all bits below the highest one."""
    w = h.bitwiseAND(F.lit((1 << (64 - bits)) - 1))
    for s in (1, 2, 4, 8, 16, 32):
        w = w.bitwiseOR(F.shiftrightunsigned(w, s))
    return (F.lit(64 - bits + 1) - F.bit_count(w)).cast("int")


def registers(df: DataFrame, dims: Sequence[str], ident: str, bits: int = BITS) -> DataFrame:
    """dims, reg, top: the largest rank per register and finest group. Null
    identifiers aren't counted; a null in dims is a group. Only registers that
    were hit have rows, so small groups stay small; equal rows fold before the
    shuffle, whatever a group's share of the rows."""
    h = F.xxhash64(F.col(ident).cast("string"))
    reg = F.shiftrightunsigned(h, 64 - bits).cast("int")
    return df.where(F.col(ident).isNotNull()).groupBy(*dims, reg.alias("reg")).agg(F.max(_leading(h, bits)).alias("top"))


def merge_registers(*parts: DataFrame) -> DataFrame:
    """Registers of several days, batches or runs put together: the maximum."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dims = [c for c in out.columns if c != "top"]
    return out.groupBy(*dims).agg(F.max("top").alias("top"))


def levels(dims: Sequence[str]) -> Column:
    """All combinations of dims as an array: level (the dims that are kept, joined by
    commas, '' for all rows) and the dims, null where they aren't kept."""
    dims = list(dims)
    sets = [c for k in range(len(dims), -1, -1) for c in combinations(dims, k)]
    return F.array(*(F.struct(F.lit(",".join(c)).alias("level"), *((F.col(d) if d in c else F.nullif(F.col(d), F.col(d))).alias(d) for d in dims)) for c in sets))


def roll_up(regs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Registers of every combination of dims (see levels). Each register of a combination
    comes from the same register of finer ones, so the rows are once dealt by
    register, which no group can make uneven, and all combinations are put together where they lie."""
    got = regs.repartition("reg").select(F.explode(levels(dims)).alias("l"), "reg", "top").select("l.*", "reg", "top")
    return got.groupBy("level", *dims, "reg").agg(F.max("top").alias("top"))


def estimate(regs: DataFrame, keys: Sequence[str], bits: int = BITS) -> DataFrame:
    """keys, n_distinct, std_error (relative), registers_hit. The estimate takes what
    the registers' values are expected to be, the empty ones' included, at any
    number of identifiers: no range of numbers has a bias of its own."""
    m = float(1 << bits)
    g = regs.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("top").cast("double"))).alias("s"), F.count(F.lit(1)).alias("hit"))
    x = (F.lit(m) - F.col("hit")) / m
    empty = x
    for k in range(1, bits + 8):  # the terms behind are below the last digit of a double
        empty = empty + F.pow(x, F.lit(float(1 << k))) * float(1 << (k - 1))
    n = F.lit(m * m / (2 * float(np.log(2)))) / (F.col("s") + F.lit(m) * empty)
    return g.select(*keys, F.round(n).cast("long").alias("n_distinct"), F.lit(standard_error(bits)).alias("std_error"), F.col("hit").alias("registers_hit"))


def distinct_counts(df: DataFrame, dims: Sequence[str], ident: str, bits: int = BITS) -> DataFrame:
    """Distinct identifiers per combination of dims, estimated."""
    return estimate(roll_up(registers(df, dims, ident, bits), dims), ["level", *dims], bits)
