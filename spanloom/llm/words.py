"""Texts as arrays of word numbers."""

from __future__ import annotations

import re

import numpy as np

WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_HYPHEN = re.compile("(?<=[^\\W_])[-\u00ad\u2010\u2011](?=[^\\W_])")


def piece_words(piece: str, joined: bool = False) -> list[str]:
    """Lower-case words of a piece of text; joined: a hyphen inside a word is left out."""
    piece = piece.lower()
    return WORD.findall(_HYPHEN.sub("", piece) if joined else piece)


class WordCoder(dict):
    """Numbers for words. Texts are split at white space by str.split, and each
    spelling of a piece is looked at once: its lower-case words are kept under
    the piece. A piece of one word has the word's number, any other piece -1
    minus its place in the list of pieces.

    fixed: the only words that get a number; all others are `other`. numbers:
    a word with a digit stands for any number. joined: hyphens inside words are left out.
    """

    def __init__(self, first: int = 0, fixed: dict[str, int] | None = None, other: int = 0, numbers: bool = False, joined: bool = False, limit: int = 2_000_000):
        super().__init__()
        self.first, self.fixed, self.other, self.numbers, self.joined, self.limit = first, fixed, other, numbers, joined, limit
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: dict[str, int] = {}
        self.lists: list[int] = []
        self.off = [0]

    def number(self, w: str) -> int:
        if self.fixed is not None:
            return self.fixed.get(w, self.other)
        if self.numbers and _DIGIT.search(w):
            w = "0"
        return self.words.setdefault(w, self.first + len(self.words))

    def __missing__(self, piece: str) -> int:
        ws = piece_words(piece, self.joined)
        if len(ws) == 1:
            got = self.number(ws[0])
        else:
            self.lists.extend(map(self.number, ws))
            self.off.append(len(self.lists))
            got = 1 - len(self.off)
        self[piece] = got
        return got

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, offsets of the texts)"""
        if len(self) > self.limit:
            self.reset()
        codes, ends = [], [0]
        for t in texts:
            p = t.split()
            codes.append(np.fromiter(map(self.__getitem__, p), np.int64, len(p)))
            ends.append(ends[-1] + len(p))
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        ends = np.array(ends)
        multi = flat < 0
        if not multi.any():
            return flat, ends
        off = np.array(self.off)
        at = np.where(multi, -1 - flat, 0)
        size = np.where(multi, off[at + 1] - off[at], 1) if len(off) > 1 else np.ones(len(flat), np.int64)
        stop = np.cumsum(size)
        src = np.repeat(np.where(multi, off[at], 0) - (stop - size), size) + np.arange(stop[-1])
        lists = np.array(self.lists or [0])
        out = np.repeat(flat, size)
        m = np.repeat(multi, size)
        out[m] = lists[src[m]]
        return out, np.concatenate([[0], stop])[ends]
