"""Vectorised reading of Arrow string columns: words, their 64-bit hashes, and word shingles.

Everything works on the UTF-8 bytes of a batch at once, so that no Python string is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The word characters of the corpus contracts: all but space and 0x09-0x0D, with A-Z folded.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = U64(0x9E3779B97F4A7C15)
_KEEP = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """(first, last) row ranges of about `most` bytes each; one longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_spans(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the word offsets of the rows. No word crosses a row."""
    inside = ~separator[raw]
    n = len(raw)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < n]
    opens[rows] = inside[rows]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, eight bytes at a time."""
    lengths = ends - starts
    h = lengths.astype(U64) * _ODD
    if not len(starts):
        return h
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    left, rows, at = lengths, None, starts
    while True:
        part = np.ascontiguousarray(eights[at]).view("<u8").ravel() & _KEEP[np.minimum(left, 8)]
        x = (part if rows is None else part ^ h[rows]) * U64(0xA0761D6478BD642F)
        x ^= x >> U64(32)
        if rows is None:
            h += x
        else:
            h[rows] = x * U64(0xE7037ED1A0B428DB)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix(h)
        rows = more if rows is None else rows[more]
        left, at = left[more] - 8, at[more] + 8


def words(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words and the word offsets of the rows."""
    raw = fold[raw]
    starts, ends, rows = word_spans(raw, offsets, separator)
    return span_hashes(raw, starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one row after the other, and their offsets.

    hashes: of the words of all rows; rows: their offsets. A row of fewer than `size` words, but some,
    has one shingle, its whole sequence.
    """
    n = len(hashes)
    words_in = np.diff(rows)
    total = np.full(n, size, U64) * _ODD
    for k in range(min(size, n)):
        head = total[: n - k]
        head *= U64(0xA0761D6478BD642F)
        head += hashes[k:]
        head ^= head >> U64(29)
    for i in np.flatnonzero((words_in > 0) & (words_in < size)):
        x = int(words_in[i]) * 0x9E3779B97F4A7C15
        for h in hashes[rows[i] : rows[i + 1]].tolist():
            x = ((x ^ h) * 0xE7037ED1A0B428DB + 1) & 0xFFFFFFFFFFFFFFFF
            x ^= x >> 31
        total[rows[i]] = x
    count = np.where(words_in >= size, words_in - size + 1, np.minimum(words_in, 1))
    total = mix(gather(total, rows[:-1], count))
    offsets = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        total[a:b].sort()
    if not len(total):
        return total, offsets
    new = np.concatenate([[True], total[1:] != total[:-1]])
    new[offsets[:-1][count > 0]] = True
    return total[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[starts[i] : starts[i] + lengths[i]] of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    return pool[np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]


def squeeze(a: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of at most `width` bytes, compressed by byte planes: high bytes are mostly zero."""
    raw = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(a).to_bytes(8, "little") + (pa.Codec("zstd").compress(raw, asbytes=True) if raw else b"")


def unsqueeze(blob: bytes, width: int = 4) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], decompressed_size=width * n), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<i8")


def runs(batches, *keys: str):
    """Tables of whole groups from batches that come sorted by the keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [np.asarray(batch.column(k)) for k in keys]
        new = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            cut = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def groups_of(table: pa.Table, *keys: str):
    """(first, last) row ranges of the groups of a table that is sorted by the keys."""
    marks = [table.column(k).to_numpy() for k in keys]
    cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
    bounds = [0, *cuts.tolist(), table.num_rows]
    return zip(bounds, bounds[1:])
