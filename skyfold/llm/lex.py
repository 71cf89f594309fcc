"""Words of whole Arrow string columns as numpy arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = (512 << 10) - 2  # with the tables of powers, some hundred bytes of working memory a byte
HELD_POWERS = 1 << 20
SLICE_TEXTS = 2048
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
_byte = np.arange(256)
#: Bytes of words for [^\x20\x09-\x0D]+; UTF-8 keeps white space of ASCII apart from all other bytes.
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Bytes of words for [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
PLAIN = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)


def raw(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the ``n + 1`` offsets of its texts; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(buf: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, end, bytes, offsets`` of runs of at most SLICE_TEXTS texts and ``limit`` bytes; a longer text comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + SLICE_TEXTS, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, end bytes and text numbers of all words; no word crosses a text."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = table[buf]
    before = np.empty_like(w)
    before[0], before[1:] = False, w[:-1]
    inner = off[(off > 0) & (off < len(buf))]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty_like(w)
    after[-1], after[:-1] = False, w[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    size = 1 << max(16, int(n - 1).bit_length())
    made = {}
    for name, m in (("up", MULT), ("down", INVERSE)):
        p = np.full(size, m, np.uint64)
        p[0] = 1
        made[name] = np.cumprod(p)
    if size <= HELD_POWERS:  # those of a very long text are made again
        _powers.update(made)
    return made["up"], made["down"]


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, in one pass over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of ``n`` consecutive symbols; the last ``n - 1`` positions have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x5851F42D4C957F2D + salt, np.uint64)
    for j in range(n):
        out += h[j : j + m] * (mix(np.array([n * 1000 + j + salt], np.uint64))[0] | np.uint64(1))
    return mix(out)


def sequence_hash(h: np.ndarray, first: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """One hash of the symbols ``first[i]..end[i]`` each, with order."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + np.uint64(salt)) * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))
