"""Lengths of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The vocabulary's file on every machine; a parameter of each operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's tokenizer divides a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_UNIT = re.compile(r"\s*\S+|\s+")


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter(dict):
    """Counts tokens piece by piece. The tokenizer never joins what stands
    before white space with what follows, so a text's count is the sum over
    pieces of white space and the characters after it; each piece is encoded
    once. Pieces between single blanks, which may hold line breaks inside, are
    taken as wholes; a text with other white space at a piece's edge is divided
    piece by piece."""

    def __init__(self, path: str = VOCABULARY, limit: int = 1_000_000):
        super().__init__()
        self.encode, self.limit = _encoding(path).encode_ordinary, limit

    def __missing__(self, piece: str) -> int:
        """piece: what follows a blank; None if it begins or ends with white space."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise ValueError
        got = self[piece] = len(self.encode(" " + piece))
        return got

    def count(self, t: str) -> int:
        if len(self) > self.limit:
            self.clear()
        head, *rest = t.split(" ")
        try:
            n = sum(map(self.__getitem__, rest))
            if not head or head[-1].isspace():
                raise ValueError
            return n + len(self.encode(head))
        except ValueError:
            n = 0
            for u in _UNIT.findall(t):
                if u[0] == " " and len(u) > 1 and not u[1].isspace():
                    n += self[u[1:]]
                else:
                    n += len(self.encode(u))
            return n


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every text; null texts give no row, empty ones 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            n = np.fromiter((counter.count(b.column(1)[i].as_py()) for i in range(b.num_rows)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, n_tokens bigint")
