"""A structural index of many JSON texts at once.

The texts lie one after the other in a byte array. Bitmaps of escapes, quotes,
brackets and delimiters give, by prefix sums, what lies inside strings and how
deep each byte is nested; what is left is a short list of tokens. From it come
node arrays: every value with its parent container, its key and its position.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, ARRAY, STRING, OTHER = 1, 2, 3, 4

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b"{}[]:,", np.uint8)] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {b"true", b"false", b"null"}
_AFTER, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_AFTER[np.frombuffer(b'"\\/bfnrtu', np.uint8)] = True
_HEX[np.frombuffer(b"0123456789abcdefABCDEF", np.uint8)] = True


@dataclass
class Nodes:
    """All values of the valid texts. Strings and scalars: start and end are
    those of the content (without quotes)."""

    data: np.ndarray  # bytes
    text: np.ndarray  # number of the text
    parent: np.ndarray  # index of the container, -1 at the top
    kind: np.ndarray  # OBJECT, ARRAY, STRING, OTHER
    start: np.ndarray
    end: np.ndarray
    key_start: np.ndarray  # -1 in arrays and at the top
    key_end: np.ndarray
    pos: np.ndarray  # 0-based position in the container
    valid: np.ndarray  # by text


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes from each start to its end, gathered at once."""
    length = end - start
    off = np.concatenate([[0], np.cumsum(length)])
    at = np.repeat(start - off[:-1], length) + np.arange(off[-1])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


class Strings:
    """Contents of JSON strings and scalars as Arrow arrays. Only those with a
    backslash, and bytes that are no UTF-8, are looked at one by one."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self._slashes = np.concatenate([[0], np.cumsum(data == 92)])

    def take(self, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
        raw = slices(self.data, start, end)
        odd = self._slashes[end] > self._slashes[start]
        try:
            got = raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array(map(unescape, raw.to_pylist()), pa.string())
        if odd.any():
            some = pa.array(map(unescape, raw.filter(pa.array(odd)).to_pylist()), pa.string())
            got = pc.replace_with_mask(got, pa.array(odd), some)
        return got


def _inside_escape(b: np.ndarray) -> np.ndarray:
    """True for bytes that an odd run of backslashes ends before."""
    slash = b == 92
    if not slash.any():
        return np.zeros(len(b), bool)
    at = np.flatnonzero(slash)
    first = np.concatenate([[True], np.diff(at) > 1])
    start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    odd = (at - start) % 2 == 0  # this backslash escapes what follows
    out = np.zeros(len(b) + 1, bool)
    out[at[odd] + 1] = True
    return out[: len(b)]


def index(texts: list[bytes | None]) -> Nodes:
    """Nodes of the texts that are valid JSON; the others have none. A null text
    isn't valid. A text of over 2 GB isn't supported."""
    n = len(texts)
    if not n:
        none = np.empty(0, np.int64)
        return Nodes(np.empty(0, np.uint8), none, none, none, none, none, none, none, none, np.empty(0, bool))
    sizes = np.fromiter((len(t) if t is not None else 0 for t in texts), np.int64, n)
    # a comma after each text keeps tokens apart and bounds scalars
    data = np.frombuffer(b",".join(t if t is not None else b"" for t in texts) + b",", np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # where the separators are
    starts = ends - sizes
    valid = np.fromiter((t is not None for t in texts), bool, n)

    escaped = _inside_escape(data)
    quote = (data == 34) & ~escaped
    # parity of quotes within each text
    count = np.cumsum(quote)
    base = np.concatenate([[0], count[ends]])[:-1]
    q_text = count[ends] - base
    valid &= q_text % 2 == 0
    broken = np.repeat(~valid, sizes + 1)
    inside = ((count - np.repeat(base, sizes + 1)) % 2 == 1) & ~broken  # from the opening quote to before the closing one
    quote &= ~broken
    # control bytes inside strings aren't allowed
    bad = inside & (data < 32)
    if bad.any():
        valid[np.searchsorted(ends, np.flatnonzero(bad))] = False
    out = ~inside & ~quote & ~broken
    mark = _MARK[data] & out
    mark[ends] = True
    blank = _SPACE[data] & out
    opening = quote & inside
    plain = out & ~mark & ~blank
    scalar = plain & ~np.concatenate([[False], plain[:-1]]) if len(plain) else plain
    token = mark | opening | scalar
    at = np.flatnonzero(token)
    text = np.searchsorted(ends, at)
    # kinds: the byte of a mark, 34 for a string, 48 for another scalar, 0 for a separator
    kind = np.where(scalar[at], 48, data[at]).astype(np.int64)
    kind[np.isin(at, ends, assume_unique=True)] = 0
    # ends of strings and scalars
    closing = np.flatnonzero(quote & ~inside)
    stop = at + 1
    s = kind == 34
    stop[s] = closing[: s.sum()] if len(closing) == s.sum() else 0
    k = kind == 48
    after = np.flatnonzero(plain & ~np.concatenate([plain[1:], [False]])) + 1
    stop[k] = after

    # depth by prefix sums; every text must end at 0 and stay above before
    step = np.where((kind == 123) | (kind == 91), 1, np.where((kind == 125) | (kind == 93), -1, 0))
    run = np.cumsum(step)
    sep = np.flatnonzero(kind == 0)
    before = np.concatenate([[0], run[sep]])[:-1]
    depth = run - before[text]
    valid &= depth[sep] == 0
    low = np.minimum.reduceat(depth, np.concatenate([[0], sep[:-1] + 1]))
    valid &= low >= 0
    keep = valid[text]
    at, text, kind, stop, step, depth = (x[keep] for x in (at, text, kind, stop, step, depth))
    m = len(at)

    # the container of each token: the last opening bracket one level up
    level = depth - (step > 0)  # depth outside of the token's own bracket
    level = np.where(step < 0, depth, level)
    order = np.lexsort((np.arange(m), level, text))
    # brackets of one level and text alternate opening and closing
    o = order[step[order] != 0]
    pair = np.full(m, -1)
    if len(o):
        good = (step[o[0::2]] == 1).all() and len(o) % 2 == 0
        a, b = o[0::2], o[1::2]
        assert good
        pair[a], pair[b] = b, a
        wrong = kind[b] - kind[a] != 2  # { } and [ ] differ by 2
        valid[text[a[wrong]]] = False
    # opened[i]: innermost open bracket before token i
    box = np.full(m, -1)
    opens = np.flatnonzero(step > 0)
    if len(opens):
        # by level: the last opening at level l-1 before i
        key_o = level[opens] * (m + 1) + opens
        srt = np.argsort(key_o)
        key_s = key_o[srt]
        want = (level - 1) * (m + 1) + np.arange(m)
        got = np.searchsorted(key_s, want) - 1
        ok = (level > 0) & (got >= 0)
        box[ok] = opens[srt[np.maximum(got, 0)]][ok]
    in_obj = (box >= 0) & (kind[np.maximum(box, 0)] == 123)

    # grammar: what may follow what
    prev = np.concatenate([[0], kind[:-1]])
    new_text = np.concatenate([[True], text[1:] != text[:-1]]) if m else np.zeros(0, bool)
    prev = np.where(new_text, 0, prev)
    value = (kind == 34) | (kind == 48) | (step > 0)
    p_value = (prev == 34) | (prev == 48) | (prev == 125) | (prev == 93)
    is_key = (kind == 34) & in_obj & ((prev == 123) | (prev == 44))
    prev_key = np.concatenate([[False], is_key[:-1]])
    ok = np.ones(m, bool)
    ok = np.where(value & (box < 0), prev == 0, ok)
    ok = np.where(value & (box >= 0) & ~in_obj, (prev == 91) | (prev == 44), ok)
    ok = np.where(value & in_obj, is_key | (prev == 58), ok)
    ok = np.where(kind == 58, prev_key, ok)
    ok = np.where(kind == 44, p_value & ~prev_key & (box >= 0), ok)
    ok = np.where(kind == 125, ((prev == 123) | (p_value & ~prev_key)), ok)
    ok = np.where(kind == 93, ((prev == 91) | p_value), ok)
    ok = np.where(kind == 0, p_value & ~prev_key, ok)
    valid[text[~ok]] = False

    # scalars, each spelling looked at once, and escapes
    ks = np.flatnonzero(kind == 48)
    if len(ks):
        spelt = slices(data, at[ks], stop[ks]).dictionary_encode()
        good = np.fromiter((w in _WORDS or _NUMBER.fullmatch(w) is not None for w in spelt.dictionary.to_pylist()), bool)
        valid[text[ks[~good[spelt.indices.to_numpy()]]]] = False
    esc = np.flatnonzero((data == 92) & ~escaped & inside)
    if len(esc):
        ahead = np.concatenate([data, np.zeros(6, np.uint8)])
        fine = _AFTER[ahead[esc + 1]]
        u = np.flatnonzero(ahead[esc + 1] == 117)
        for k in range(2, 6):
            fine[u] &= _HEX[ahead[esc[u] + k]]
        valid[np.searchsorted(ends, esc[~fine])] = False
    outside = np.flatnonzero((data == 92) & ~inside)
    if len(outside):
        valid[np.searchsorted(ends, outside)] = False

    # nodes
    v = np.flatnonzero(value & ~is_key & valid[text])
    number = np.full(m, -1)
    number[v] = np.arange(len(v))
    parent = np.where(box[v] >= 0, number[np.maximum(box[v], 0)], -1)
    kinds = np.where(kind[v] == 123, OBJECT, np.where(kind[v] == 91, ARRAY, np.where(kind[v] == 34, STRING, OTHER)))
    quoted = kinds == STRING
    cont = step[v] > 0
    start = at[v] + quoted
    end = np.where(cont, at[np.maximum(pair[v], 0)] + 1, stop[v])
    has_key = in_obj[v]
    kt = np.maximum(v - 2, 0)
    key_start = np.where(has_key, at[kt] + 1, -1)
    key_end = np.where(has_key, stop[kt], -1)
    # position among the container's values
    srt = np.lexsort((v, parent))
    ps = parent[srt]
    first = np.concatenate([[True], ps[1:] != ps[:-1]]) if len(v) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    pos = np.empty(len(v), np.int64)
    pos[srt] = np.arange(len(v)) - begin
    return Nodes(data, text[v], parent, kinds, start, end, key_start, key_end, pos, valid)


def unescape(raw: bytes) -> str:
    """The string that a JSON string's content stands for."""
    if b"\\" not in raw:
        return raw.decode("utf-8", "replace")
    s = json.loads(b'"' + raw + b'"')
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # lone surrogates can't be written
