"""Cutting texts into the pieces within which a BPE tokenizer merges, on whole Arrow batches.

Both public vocabularies cut a text by the classes letter, number, white space and other, with the
English contractions apart. The classes come from one table over all code points; the cuts are array
operations; equal pieces are found by their hashes, so that each is encoded once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

from threadloom.llm import textkernel as tk

OTHER, LETTER, NUMBER, WHITE = range(4)
_CONTRACTED = {1: "stmd", 2: ("re", "ve", "ll")}


def byte_letters() -> str:
    """The letters that stand for the bytes 0 to 255 in byte-level vocabularies: a byte itself if it can be printed."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256))


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    return out


def cut(raw: np.ndarray, offsets: np.ndarray, spaces_join: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the pieces of UTF-8 rows, and the piece offsets of the rows.

    spaces_join: a single space belongs to the piece after it, other white space is a piece too, and
    numbers are pieces of any length. Otherwise white space is left out and each digit is a piece.
    """
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none, none, np.zeros(len(offsets), np.int64)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(code)
    ascii_only = n == len(raw)
    lead = None if ascii_only else np.flatnonzero((raw & 0xC0) != 0x80)
    bound = offsets if ascii_only else np.searchsorted(lead, offsets)
    rows = bound[:-1][np.diff(bound) > 0]  # first code points of the rows that have some
    kind = classes()[code]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[rows] = True
    runs = np.flatnonzero(new)
    ends = np.append(runs[1:], n)
    of = kind[runs]
    row_first = np.zeros(n + 1, bool)
    row_first[rows] = True
    row_first[n] = True
    followed = ~row_first[ends]  # another run of the same row comes next
    if spaces_join:
        white = np.flatnonzero((of == WHITE) & followed)
        last = ends[white] - 1
        new[last] = True
        joins = code[last] == 0x20
        new[ends[white][joins]] = False
    else:
        new |= kind == NUMBER
    marks = np.flatnonzero((code[runs] == 0x27) & (of == OTHER) & (ends - runs == 1) & followed)
    for r in marks.tolist():  # an apostrophe alone, with letters after it
        if of[r + 1] != LETTER or not new[runs[r]]:
            continue
        q, e = int(runs[r]), int(ends[r + 1])
        one, two = chr(code[q + 1]), "".join(map(chr, code[q + 1 : min(q + 3, e)].tolist()))
        k = 1 if one in _CONTRACTED[1] else 2 if two in _CONTRACTED[2] else 0
        if k:
            new[q + 1] = False
            if q + 1 + k < e:
                new[q + 1 + k] = True
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    if not spaces_join:
        keep = kind[starts] != WHITE
        starts, stops = starts[keep], stops[keep]
    pieces = np.searchsorted(starts, bound)
    if ascii_only:
        return starts, stops, pieces
    lead = np.append(lead, len(raw))
    return lead[starts], lead[stops], pieces


class PieceCache:
    """Token ids of pieces, by hash; `encode` takes a list of pieces and gives id lists.

    letters: the character (below 0xD800) that stands for each byte in the pieces given to `encode`.

    Holds `most` pieces; when full it starts anew, which costs time but changes no result.
    """

    def __init__(self, encode, letters: str, most: int = 500_000):
        self.encode, self.most = encode, most
        self.letters = np.array([ord(c) for c in letters], "<u2")
        self._clear()

    def _clear(self):
        self.place: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 20, np.uint16), 0
        self.starts, self.lengths = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _add(self, hashes: list[int], ids: list[list[int]]) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int64)
        if len(flat) and flat.max() > 0xFFFF and self.pool.dtype != np.uint32:
            self.pool = self.pool.astype(np.uint32)
        n = len(self.place)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ids) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(ids)] = lengths
        self.place.update(zip(hashes, range(n, n + len(ids))))
        self.used += len(flat)

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, one after the other, and how many each has."""
        at, hashes = pd.factorize(tk.span_hashes(raw, starts, ends))
        if len(self.place) + len(hashes) > self.most:
            self._clear()
        hashes = hashes.tolist()
        where = [self.place.get(h, -1) for h in hashes]
        lacking = [i for i, p in enumerate(where) if p < 0]
        if lacking:
            seen = np.maximum.accumulate(at)
            first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))[lacking]
            text = self.letters[raw].tobytes().decode("utf-16-le")
            self._add([hashes[i] for i in lacking], self.encode([text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]))
            where = [self.place[h] for h in hashes]
        where = np.array(where, np.int64)[at] if hashes else np.zeros(0, np.int64)
        return tk.gather(self.pool, self.starts[where], lengths := self.lengths[where]), lengths
