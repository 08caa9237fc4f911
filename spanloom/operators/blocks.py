"""Blocks of spans: manifest, terms, statistics, retention and merging plans.

A block is any grouping of spans, in a store its files. These operators take
and give small tables of one row per block."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources.schema import PROMOTED, RESOURCE_TERMS, TERM_ATTRIBUTES, TERM_BOTH, lookup, text

DAY_NS = 86_400_000_000_000


def day_block() -> Column:
    return F.call_function("div", F.col("start_time"), F.lit(DAY_NS).cast("long"))


def terms() -> Column:
    """The index terms of a span, without repetition and nulls."""
    a, r = F.col("attributes"), F.col("resource")

    def term(k: str, v: Column) -> Column:
        return F.concat(F.lit(k + ":"), v)

    parts = [term("name", F.col("name")), term("kind", F.col("kind")), term("status", F.col("status")), term("service.name", lookup("service.name"))]
    parts += [term(k, text(m[k])) for k in TERM_BOTH for m in (r, a)]
    parts += [term(k, text(a[k])) for k in TERM_ATTRIBUTES]
    return F.array_distinct(F.array_compact(F.array(*parts)))


def term_sets(columns: Iterable[str]) -> tuple[list[Column], Column]:
    """Aggregates of the distinct values of each term's promoted column, and the
    array of terms that they make: a block's terms without a row per span and term."""
    columns = set(columns)
    cols = [("name", F.col("name")), ("kind", F.col("kind")), ("status", F.col("status")), *((k, F.col(c)) for k, c in PROMOTED.items())]
    # a key of attributes and of resource: the promoted value is the first that is there
    cols += [(k, F.col(c) if c in columns else text(F.col("resource")[k])) for k, c in RESOURCE_TERMS.items()]
    names = [f"_set_{i}" for i in range(len(cols))]
    sets = [F.collect_set(c).alias(n) for (_, c), n in zip(cols, names, strict=True)]
    return sets, F.array_distinct(F.concat(*(_terms_of(k, F.col(n)) for (k, _), n in zip(cols, names, strict=True))))


def _terms_of(key: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{key}:"), v))


def term_index(spans: DataFrame, block: Column) -> DataFrame:
    """Distinct (term, block_id)."""
    if not set(PROMOTED.values()) <= set(spans.columns):
        return spans.select(block.alias("block_id"), F.explode(terms()).alias("term")).distinct()
    sets, got = term_sets(spans.columns)
    return spans.groupBy(block.alias("block_id")).agg(*sets).select("block_id", F.explode(got).alias("term"))


def term_values(index: DataFrame, key: str) -> DataFrame:
    """block_id and value of the terms of one key: the term without its prefix."""
    prefix = f"{key}:"
    return index.where(F.startswith("term", F.lit(prefix))).select("block_id", F.substring("term", len(prefix) + 1, 2**31 - 1).alias("value"))


def holding(terms: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Of blocks with their arrays of terms those that hold all of the wanted terms."""
    for t in sorted(set(wanted)):
        terms = terms.where(F.array_contains("terms", t))
    return terms


#: Endings of block files.
FORMATS = {"raw": "raw", "zst": "zstd", "ozl": "openzl"}


def format_of(path: Column | str) -> Column:
    """The format that a block file's ending tells; null for other endings."""
    end = F.regexp_extract(path, r"\.([a-z]+)$", 1)
    out = F.lit(None).cast("string")
    for k, v in FORMATS.items():
        out = F.when(end == k, v).otherwise(out)
    return out


def matching_blocks(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Blocks that hold all of the wanted terms."""
    wanted = sorted(set(wanted))
    return index.where(F.col("term").isin(wanted)).groupBy("block_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(wanted)).select("block_id")


def manifest(spans: DataFrame, block: Column) -> DataFrame:
    """block_id, entry_count, ts_min, ts_max (of start_time)."""
    return spans.groupBy(block.alias("block_id")).agg(F.count(F.lit(1)).alias("entry_count"), F.min("start_time").alias("ts_min"), F.max("start_time").alias("ts_max"))


def overlapping(blocks: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """Blocks whose time range meets since..until."""
    if since is not None:
        blocks = blocks.where(F.col("ts_max") >= since)
    if until is not None:
        blocks = blocks.where(F.col("ts_min") <= until)
    return blocks


def live_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block that isn't marked deleted; of repeated rows the latest."""
    last = F.max_by(F.struct(*(c for c in blocks.columns if c != "block_id")), F.struct("created_at", "byte_size", "entry_count"))
    return blocks.where("deleted_at is null and block_id is not null").groupBy("block_id").agg(last.alias("r")).select("block_id", "r.*")


def stats_by_format(blocks: DataFrame) -> DataFrame:
    """Per format and in all (format '*'): blocks, entries, bytes, time range."""
    g = blocks.groupingSets([["block_format"], []], "block_format").agg(
        F.grouping("block_format").alias("all"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum("entry_count").alias("n_entries"),
        F.sum("byte_size").alias("n_bytes"),
        F.min("ts_min").alias("ts_min"),
        F.max("ts_max").alias("ts_max"),
    )
    return g.select(F.when(F.col("all") == 1, "*").otherwise(F.coalesce("block_format", F.lit(""))).alias("block_format"), "n_blocks", "n_entries", "n_bytes", "ts_min", "ts_max")


def raw_backlog(blocks: DataFrame) -> DataFrame:
    return blocks.where("block_format = 'raw'").agg(F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("n_entries"), F.min("created_at").alias("oldest"))


def expired_by_age(blocks: DataFrame, cutoff_ns: int) -> DataFrame:
    return blocks.where(F.col("ts_max") < cutoff_ns)


def expired_by_weight(blocks: DataFrame, weight: str, most: int) -> DataFrame:
    """The oldest blocks that go until at most `most` of weight is left: a block
    goes if what remains before it goes is above. The window's rows are one
    per block of the manifest, not data."""
    w = W.orderBy("ts_min", "block_id")
    all_ = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    gone = F.coalesce(F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("_left", all_ - gone).where(F.col("_left") > most).drop("_left")


def expired_by_size(blocks: DataFrame, max_bytes: int) -> DataFrame:
    return expired_by_weight(blocks, "byte_size", max_bytes)


def expired_by_terms(blocks: DataFrame, index: DataFrame, max_terms: int) -> DataFrame:
    counts = index.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_terms"))
    got = blocks.join(counts, "block_id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    return expired_by_weight(got, "n_terms", max_terms)


def merge_candidates(blocks: DataFrame, below: int = 2000) -> DataFrame:
    return blocks.where(F.col("entry_count") < below).orderBy("ts_min", "block_id")


def merge_plan(sizes: list[tuple], target: int = 2000, at_least: int = 4) -> list[list]:
    """Batches of block ids to be rewritten as one block each, from (block_id,
    entry_count) in order of ts_min. A batch ends before the block that would
    bring it above target; the last one counts only with two blocks or more.
    Fewer than at_least blocks: none."""
    if len(sizes) < at_least:
        return []
    out, held, room = [], [], target
    for block, k in sizes:
        if held and k > room:
            out.append(held)
            held, room = [], target
        held.append(block)
        room -= k
    return out + [held] * (len(held) >= 2)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old that new doesn't replace, and new."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and the rows of new that aren't in it, each once."""
    return old.unionByName(new).distinct()


def delete_blocks(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("block_id"), "block_id", "left_anti")
