"""Texts as flat byte arrays: words, hashes and windows without a Python loop per word.

A batch of texts is one UTF-8 buffer with offsets, as Arrow holds it. All separators are
ASCII bytes, so words can be found on bytes. Work goes over pieces of about ``PIECE``
bytes that end between words, so temporary arrays stay small however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 19
#: Spans above this many bytes are hashed one by one.
LONG_SPAN = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
U64 = np.uint64

#: Not white space: words are runs of these.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters for language models: ASCII letters and every byte of a longer character.
LETTER_BYTE = np.zeros(256, bool)
LETTER_BYTE[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Texts(NamedTuple):
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    start: np.ndarray  # byte positions in Texts.data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end
    hash: np.ndarray | None

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """A string or binary column as bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of ``column``, one row at least."""
    sizes = np.diff(texts(batch.column(column)).offsets)
    total = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        base = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WINDOWS = _Powers(_BASE), _Powers(_WINDOW_BASE)


def _pieces(t: Texts, inside: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo, hi = 0, len(t.data)
    while lo < hi:
        end = min(lo + limit, hi)
        if end < hi:
            gaps = np.flatnonzero(~inside[t.data[lo:end]])
            if len(gaps):
                end = lo + int(gaps[-1]) + 1
            else:
                k = int(np.searchsorted(t.offsets, lo, "right"))
                stop = int(t.offsets[k]) if k < len(t.offsets) else hi
                ahead = end
                while ahead < stop:
                    gaps = np.flatnonzero(~inside[t.data[ahead : ahead + limit]])
                    if len(gaps):
                        stop = min(stop, ahead + int(gaps[0]) + 1)
                    ahead += limit
                end = stop
        yield lo, end
        lo = end


_TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_STEP = U64(0x9FB21C651E98DF25)


def eights(data: np.ndarray) -> np.ndarray:
    """The 64-bit number that the eight bytes from each place on make, zeros beyond the end."""
    pad = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.lib.stride_tricks.as_strided(pad[:8].view(np.uint64), (len(data) + 8,), (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), the same wherever a span stands.

    Eight bytes a step go through a bijection that mixes every bit, over all spans at once, so no
    arrangement of letters collides by its structure; spans of up to 7 bytes never collide among
    themselves. Long spans are hashed one by one (XXH3).
    """
    size = ends - starts
    at = eights(data)
    h = at[starts] & _TAIL[np.minimum(size, 8)]
    short = size < 8
    h[short] |= size[short].astype(np.uint64) << U64(56)
    h[~short] ^= size[~short].astype(np.uint64) * _STEP
    mix(h)
    rest = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(rest):
        part = at[starts[rest] + done] & _TAIL[np.minimum(size[rest] - done, 8)]
        h[rest] = mix((h[rest] ^ part) * _STEP)
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def place_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of spans that may overlap, in constant time each.

    They find candidates only: special arrangements collide, so what meets must be compared.
    """
    up, down = _BYTES.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + U64(1)) * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * U64(0x165667B19E3779F9)
    return mix(h)


def words(t: Texts, inside: np.ndarray = WORD_BYTE, hashed: bool = True, limit: int = PIECE) -> Words:
    """The maximal runs of ``inside`` bytes of every text, in order."""
    starts, ends, hashes = [], [], []
    for lo, hi in _pieces(t, inside, limit):
        part = t.data[lo:hi]
        here = inside[part]
        edge = t.offsets[np.searchsorted(t.offsets, lo, "left") : np.searchsorted(t.offsets, hi, "left")] - lo
        before = np.empty(len(here), bool)
        before[0], before[1:] = False, here[:-1]
        before[edge] = False
        after = np.empty(len(here), bool)
        after[-1], after[:-1] = False, here[1:]
        after[edge[edge > 0] - 1] = False
        s, e = np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1
        if hashed:
            hashes.append(span_hash(part, s, e))
        starts.append(s + lo)
        ends.append(e + lo)
    empty = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else empty
    end = np.concatenate(ends) if ends else empty
    h = (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)) if hashed else None
    return Words(start, end, np.searchsorted(start, t.offsets), h)


def _strings(first: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def span_strings(t: Texts, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans [start, end), in any order, as strings."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])
    return _strings(first, t.data[np.arange(first[-1]) + np.repeat(start - first[:-1], size)])


def ordered_strings(t: Texts, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """As ``span_strings``, for spans that are in order and do not overlap."""
    inside = np.zeros(len(t.data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    return _strings(np.concatenate([[0], np.cumsum(end - start)]), t.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``n`` consecutive words of one text, and where each begins."""
    count = len(hashes)
    if count < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.empty(count - n + 1, np.uint64)
    step = PIECE
    for lo in range(0, count - n + 1, step):
        hi = min(lo + step, count - n + 1)
        part = hashes[lo : hi + n - 1]
        up, down = _WINDOWS.get(step + n)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[lo:hi] = (total[n:] - total[: len(part) - n + 1]) * down[: hi - lo]
    room = np.zeros(count + 1, np.int64)  # windows that would leave their text
    sizes = np.diff(first)
    full = sizes >= n
    np.add.at(room, first[:-1][full], 1)
    np.add.at(room, first[1:][full] - n + 1, -1)
    at = np.flatnonzero(np.cumsum(room[:-1]) > 0)
    return mix(out[at]), at


def joined(t: Texts, w: Words, keep: np.ndarray | None = None, table: np.ndarray | None = None) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Texts of their words joined by one space, with each kept word's new start and end.

    ``keep`` marks the words to keep; ``table`` maps bytes (as to lower case).
    """
    kept = slice(None) if keep is None else keep
    s, e = w.start[kept], w.end[kept]
    if keep is None:
        first = w.first
    else:
        count = np.zeros(len(w.start) + 1, np.int64)
        np.cumsum(keep, out=count[1:])
        first = count[w.first]
    last = np.zeros(len(s), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    size = e - s + ~last
    new_end = np.cumsum(size)
    new_start = new_end - size
    total = int(new_end[-1]) if len(s) else 0
    flat = np.zeros(len(t.data) + 1, np.int8)
    flat[s] += 1
    flat[e] -= 1
    body = t.data[np.cumsum(flat[:-1], dtype=np.int8).view(bool)]
    out = np.empty(total, np.uint8)
    gap = np.zeros(total, bool)
    gap[new_end[~last] - 1] = True
    out[gap] = 0x20
    out[~gap] = body if table is None else table[body]
    offsets = np.concatenate([new_start, [total]])[first] if len(s) else np.zeros(len(t) + 1, np.int64)
    return Texts(out, offsets), new_start, new_end - ~last
