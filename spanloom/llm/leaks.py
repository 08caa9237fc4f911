"""Evaluation texts leaking into training text."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.fmindex import FMIndex
from spanloom.llm.words import WordCoder, piece_words
from spanloom.runtime import cut, work_path

#: Words in a stretch that counts.
STRETCH = 5
#: Characters of text in one index.
SHARD_CHARS = 6_000_000
#: Test passages that are searched for together; more take more blocks, not more indexes.
ITEM_BLOCK = 5_000
#: A stretch that more items than this share doesn't make a pair by itself.
SHARED = 3

#: A line's end with two numbers, such as the page's and how many there are: no
#: sentence ends so.
_NUMBERS = re.compile(r"(?<![\w.,/-])(\d{1,4}) ?(?:/|[^\W\d_]{1,4}) ?(\d{1,4})[^\w.!?;:,)\n]{0,20}(?=\n|$)")
_DIGITS = re.compile(r"\d+")
_BREAK = re.compile("[-\u00ad]\n\\s*")


def headers(t: str) -> list[tuple[int, int]]:
    """Where the lines of page headers begin and end. A header ends with the page's number
    and the number of pages. It stands alone between empty lines, or it recurs:
    the same line but for digits, with the same number of pages and rising page numbers."""
    alone, others = [], {}
    for m in _NUMBERS.finditer(t):
        page, pages = int(m[1]), int(m[2])
        if not 1 <= page <= pages:
            continue
        a, b = t.rfind("\n", 0, m.start()) + 1, m.end()
        if (a == 0 or t[a - 2 : a] == "\n\n" or a == 1) and t[b : b + 2] in ("\n\n", "\n", ""):
            alone.append((a, b))
        else:
            others.setdefault((_DIGITS.sub("0", t[a:b]), pages), []).append((page, a, b))
    for got in others.values():
        if len(got) > 1 and all(x[0] < y[0] for x, y in zip(got, got[1:], strict=False)):
            alone += [(a, b) for _, a, b in got]
    return sorted(alone)


def plain(t: str) -> str:
    """Text without the lines of page headers, and with words that a line's end
    divides joined."""
    cuts, last = [], 0
    for a, b in headers(t):
        if a >= last:
            cuts.append(t[last:a])
            last = b
    if cuts:
        t = "".join([*cuts, t[last:]])
    return _BREAK.sub("", t) if "-\n" in t or "\u00ad\n" in t else t


class Items:
    """Passages as stretches: for each distinct stretch its words, and where it
    stands in which item."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.size = [], [], []
        words: dict[str, int] = {}
        text = []
        for i, p in rows:
            ws = [w for piece in plain(p or "").split() for w in piece_words(piece, joined=True)]
            if len(ws) >= STRETCH:
                self.ids.append(i)
                self.size.append(len(ws))
                text.append([words.setdefault(w, len(words)) for w in ws])
        self.vocabulary = list(words)
        self.size = np.array(self.size, np.int64)
        grams: dict[tuple, int] = {}
        g, item, pos = [], [], []
        for n, ws in enumerate(text):
            for p in range(len(ws) - STRETCH + 1):
                g.append(grams.setdefault(tuple(ws[p : p + STRETCH]), len(grams)))
                item.append(n)
                pos.append(p)
        self.grams = np.array(list(grams), np.int64).reshape(-1, STRETCH)
        g, self.item, self.pos = np.array(g, np.int64), np.array(item, np.int64), np.array(pos, np.int64)
        order = np.argsort(g, kind="stable")
        self.item, self.pos = self.item[order], self.pos[order]
        self.off = np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(grams)))])
        # items of each stretch; stretches that many items share can make up less than half of most items
        k = np.diff(self.off)
        shared = np.repeat(k > SHARED, k)
        only = self._covered(self.item[shared], self.pos[shared], np.arange(len(self.ids)))
        self.full = 2 * only >= self.size  # for these items shared stretches count like others
        self.opens = ~shared | self.full[self.item]  # entries that make a pair

    def _covered(self, pair: np.ndarray, pos: np.ndarray, item_of: np.ndarray) -> np.ndarray:
        """Words of the passage inside the stretches at pos, for each pair."""
        width = self.size[item_of] + 1
        base = np.concatenate([[0], np.cumsum(width)])
        step = np.zeros(base[-1] + 1, np.int64)
        u = np.unique(base[pair] + pos)
        np.add.at(step, u, 1)
        np.add.at(step, u + STRETCH, -1)
        inside = np.cumsum(step)[:-1] > 0
        return np.add.reduceat(inside, base[:-1]) if len(item_of) else np.empty(0, np.int64)

    def match(self, doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, covered words) from distinct pairs of document and stretch."""
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        g = len(self.grams)
        there = doc * g + gram
        e, src = _ranges(self.off[gram], self.off[gram + 1])
        opens = self.opens[e]
        n = len(self.ids)
        pairs, inv = np.unique(doc[src[opens]] * n + self.item[e[opens]], return_inverse=True)
        p_doc, p_item = pairs // n, pairs % n
        pair, pos = inv, self.pos[e[opens]]
        # stretches that many items share, for the pairs that others have made
        k = np.flatnonzero(~self.opens)
        k = k[np.argsort(self.item[k], kind="stable")]
        lo, hi = np.searchsorted(self.item[k], p_item), np.searchsorted(self.item[k], p_item, "right")
        at, which = _ranges(lo, hi)
        entry = k[at]
        gram_of = np.searchsorted(self.off, entry, "right") - 1
        want = p_doc[which] * g + gram_of
        i = np.minimum(np.searchsorted(there, want), max(0, len(there) - 1))
        hit = there[i] == want if len(there) else np.zeros(0, bool)
        pair, pos = np.concatenate([pair, which[hit]]), np.concatenate([pos, self.pos[entry[hit]]])
        got = self._covered(pair, pos, p_item)
        leak = 2 * got >= self.size[p_item]
        return p_doc[leak], p_item[leak], got[leak]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi and the range of each."""
    k = hi - lo
    src = np.repeat(np.arange(len(lo)), k)
    return np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo, k), src


class Shard:
    """Texts under one index."""

    def __init__(self, coder: WordCoder, ids: list[int], texts: list[str]):
        flat, off = coder.encode([plain(t) for t in texts])
        self.ids, self.size = np.array(ids, np.int64), np.diff(off)
        # word 1 stands after each text
        self.index = FMIndex(np.insert(flat + 2, off[1:], 1))
        self.begin = off[:-1] + np.arange(len(texts))
        self.words = coder.words


def search_shard(shard: Shard, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, covered words) of the leaks in a shard, and (text, first word) of the
    stretches of the leaked passages."""
    none = np.empty(0, np.int64)
    if not len(items.ids):
        return none, none, none, none, none
    size, begin = shard.size, shard.begin
    number = np.array([shard.words.get(x, -2) + 2 for x in items.vocabulary] or [0], np.int64)
    lo, hi = shard.index.search(number[items.grams])
    rows, gram = _ranges(lo, hi)
    place = shard.index.locate(rows)
    doc = np.searchsorted(begin, place, "right") - 1
    g = len(items.grams)
    seen = np.unique(doc * g + gram)
    d, i, got = items.match(seen // g, seen % g)
    # places of the stretches of leaked items
    n = max(1, len(items.ids))
    leaks = np.unique(d * n + i)
    some = np.isin(doc, d)
    e, src = _ranges(items.off[gram[some]], items.off[gram[some] + 1])
    s_doc, s_at = doc[some][src], (place - begin[doc])[some][src]
    keep = np.isin(s_doc * n + items.item[e], leaks)
    return d, i, got, s_doc[keep], s_at[keep]


def merged(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the stretches at these places, those that meet put together."""
    width = int(at.max(initial=0)) + STRETCH + 2
    spot = np.unique(doc * width + at)
    first = np.ones(len(spot), bool)
    first[1:] = spot[1:] > spot[:-1] + STRETCH
    a = np.flatnonzero(first)
    b = np.concatenate([a[1:], [len(spot)]]) - 1 if len(a) else a
    return spot[a] // width, spot[a] % width, spot[b] % width + STRETCH


def _prepared(eval_items: DataFrame, item_block: int) -> tuple[str, int]:
    """Blocks of passages, made ready as tasks and written one per row into the shared
    folder: (path, number of blocks). No passage passes through the driver."""
    rows = cut(eval_items.select("item_id", "passage").where("item_id is not null and passage is not null").withColumn("no", F.monotonically_increasing_id()), "passages")
    blocks = max(1, -(-rows.count() // item_block))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"items": [pickle.dumps(Items(list(zip(pdf["item_id"].tolist(), pdf["passage"].tolist(), strict=True))))]})

    got = rows.repartition(blocks, F.pmod("no", F.lit(blocks))).groupBy(F.pmod("no", F.lit(blocks)).alias("b")).applyInPandas(make, "items binary")
    path = work_path(eval_items.sparkSession, "items")
    got.write.parquet(path)
    return path, blocks


def _blocks(path: str) -> Iterator[Items]:
    """The blocks below path, one at a time."""
    from pyarrow import fs

    where, p = fs.FileSystem.from_uri(path.removeprefix("file://").removeprefix("file:"))
    for f in sorted(x.path for x in where.get_file_info(fs.FileSelector(p)) if x.base_name.startswith("part-")):
        with where.open_input_file(f) as src:
            for batch in pq.ParquetFile(src).iter_batches(batch_size=1):
                yield pickle.loads(batch.column(0)[0].as_py())


def _run(documents: DataFrame, path: str, blocks: int, spans: bool) -> DataFrame:
    shape = "doc_id bigint, span_start bigint, span_end bigint" if spans else "item_id bigint, doc_id bigint, covered_words bigint, passage_words bigint"
    names = [x.split()[0] for x in shape.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held = WordCoder(joined=True), []
        for ids, texts in shards(batches, SHARD_CHARS):
            shard = Shard(coder, ids, texts)
            s_doc, s_at = [], []
            for items in held or _blocks(path):
                if blocks == 1:
                    held = [items]
                d, i, got, sd, sa = search_shard(shard, items)
                if spans:
                    s_doc.append(sd)
                    s_at.append(sa)
                elif len(d):
                    cols = [np.array(items.ids, np.int64)[i], shard.ids[d], got, items.size[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)
            if s_doc:
                d, a, b = merged(np.concatenate(s_doc), np.concatenate(s_at))
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids[d]), pa.array(a), pa.array(b)], names)

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(find, shape)


def shards(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list[int], list[str]]]:
    """Whole texts in groups of about as many characters; one longer text is a group alone."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for i in range(b.num_rows):
            t = b.column(1)[i].as_py()
            if texts and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(b.column(0)[i].as_py())
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


def leaked_items(documents: DataFrame, eval_items: DataFrame, spans: bool = False, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Documents that reproduce at least half of the words of an item's passage
    in stretches of STRETCH or more consecutive words: item_id, doc_id,
    covered_words, passage_words; with spans the places of these stretches
    instead (doc_id, span_start, span_end in words of the text without page
    headers and with words hyphenated at line ends joined), merged.

    Each shard of texts gets an FM-index, once; every stretch of the passages is
    looked up in it backwards, and its places come from sampled suffix
    positions. A shard holds whole documents, so no rows are exchanged.
    The items are the query set: blocks of item_block of them lie in the shared folder,
    and each task reads one block after the other for each of its shards, so the corpus
    is gone through once and memory doesn't grow with the number of items.
    Null and empty texts, and passages of fewer than STRETCH words, have no
    leaks. Repeated documents and items are found each.
    """
    return _run(documents, *_prepared(eval_items, item_block), spans)
