"""Repetition inside a single document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.leaks import shards
from spanloom.llm.quantiles import answers, merge_summaries, summarise
from spanloom.llm.words import WordCoder
from spanloom.runtime import cut

#: Words in a run that counts as repeated.
RUN = 8
#: Share of repeated words of a document that is high by itself.
HIGH = 1 / 3
#: The adaptive threshold of a language and source: this quantile plus SPREAD
#: times the distance of the quantile from the median.
QUANTILE, SPREAD = 0.95, 1.0
SHARD_CHARS = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 64 bits."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(flat: np.ndarray, off: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each text the words that lie in a run of `run` words that occurred
    earlier in the same text."""
    n, docs = len(flat), len(off) - 1
    out = np.zeros(docs, np.int64)
    if n < run:
        return out
    x = _mix(flat)
    h = np.zeros(n - run + 1, np.uint64)
    for k in range(run):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[k : n - run + 1 + k]
    doc = np.repeat(np.arange(docs), np.diff(off))
    start = np.flatnonzero(doc[: n - run + 1] == doc[run - 1 :])
    key = _mix(h[start] ^ _mix(doc[start]))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if new.all():
        return out
    at = start[order]
    first = np.minimum.reduceat(at, np.flatnonzero(new))[np.cumsum(new) - 1]
    later = at != first
    at, first = at[later], first[later]
    # the same hash must be the same words
    same = doc[at] == doc[first]
    for k in range(run):
        same &= flat[at + k] == flat[first + k]
    at = at[same]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + run, -1)
    inside = np.cumsum(step)[:-1] > 0
    return np.bincount(doc[inside], minlength=docs)


def _flat(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c


def repeat_shares(documents: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, lang, source, n_words, n_repeated, share. lang in lower case
    without blanks; null lang and source become ''. Letter case, punctuation,
    line breaks and the value of numbers make no difference. A null text gives
    no row; one without words has share 0."""
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit(""))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(numbers=True)

        def keep() -> Iterator[pa.RecordBatch]:
            for b in batches:
                extra.append(pa.table({"lang": b.column(2), "source": b.column(3)}))
                yield b

        extra: list[pa.Table] = []
        for ids, texts in shards(keep(), SHARD_CHARS):
            flat, off = coder.encode(texts)
            again = repeated_words(flat, off, run)
            n = np.diff(off)
            held = pa.concat_tables(extra)
            now = held.slice(0, len(ids)).combine_chunks()
            extra[:] = [held.slice(len(ids))]
            cols = [pa.array(ids, pa.int64()), *(_flat(c) for c in now.columns), pa.array(n.astype(np.int64)), pa.array(again.astype(np.int64)), pa.array(again / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "source", "n_words", "n_repeated", "share"])

    shape = "doc_id bigint, lang string, source string, n_words bigint, n_repeated bigint, share double"
    return documents.where("doc_id is not null and text is not null").select("doc_id", "text", lang.alias("lang"), F.coalesce("source", F.lit("")).alias("source")).mapInArrow(solve, shape)


def thresholds(shares: DataFrame, eps: float = 0.005) -> DataFrame:
    """lang, source, threshold, n: from mergeable summaries of the shares, one
    per partition, language and source."""
    keys = ["lang", "source"]
    got = answers(merge_summaries(summarise(shares, keys, "share", eps), keys, eps), keys, [0.5, QUANTILE])
    mid = F.max(F.when(F.col("q") == 0.5, F.col("value")))
    top = F.max(F.when(F.col("q") == QUANTILE, F.col("value")))
    return got.groupBy(*keys).agg((top + SPREAD * (top - mid)).alias("threshold"), F.max("n").alias("n"))


def flagged(documents: DataFrame, eps: float = 0.005, most: float | None = None) -> DataFrame:
    """Documents whose share lies above the threshold of their language and
    source, with the threshold. most: a group whose threshold exceeds it is held to
    it, so that a group full of spam can't hide it."""
    shares = cut(repeat_shares(documents), "shares")
    t = thresholds(shares, eps)
    if most is not None:
        t = t.withColumn("threshold", F.least("threshold", F.lit(most)))
    return shares.join(t.drop("n"), ["lang", "source"]).where("share >= threshold and share > 0")


def highly_repetitive(documents: DataFrame) -> DataFrame:
    """Documents of which at least a third of the words is repeated: those the
    adaptive thresholds (at most a third) flag, held against the third exactly."""
    return flagged(documents, most=HIGH).where("3 * n_repeated >= n_words").select("doc_id")
