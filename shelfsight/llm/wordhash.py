"""Vectorised word and word-window hashing over Arrow text columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` (or another set
of gap bytes). Its 64-bit hash takes eight bytes at a time, each step a
bijection of the state and of the block (words of up to eight bytes and one
length never collide); words of over ``LONG`` bytes go through BLAKE2. No sums
or products of positions occur, so there are no families of colliding words as
polynomial hashes modulo a power of two have. No Python object is made per
word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

LONG = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_COMBINE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BLANK = np.arange(256) == 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit avalanche (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow array without nulls."""
    wide = pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    o = o.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def _edges(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a document's end ends a word."""
    space = gap[buf]
    edge = np.empty(len(buf), bool)
    edge[0], edge[1:] = True, space[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    edge[inner] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1], edge[:-1] = True, space[1:]
    edge[inner - 1] = True
    return starts, np.flatnonzero(edge & ~space) + 1


def hash_words(buf: np.ndarray, offsets: np.ndarray, lower: bool, gap: np.ndarray = _SPACE):
    """(hashes, starts, ends, bounds): one hash and byte range per word of
    the batch; document i has the words ``bounds[i]:bounds[i + 1]``. ``gap``
    marks the bytes between words."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    starts, ends = _edges(buf, offsets, gap)
    raw = np.zeros(len(buf) + 8, np.uint8)
    raw[:-8] = _LOWER[buf] if lower else buf
    eight = np.ndarray(len(buf) + 1, "<u8", raw.data, strides=(1,))  # the eight bytes from every place on
    size = ends - starts
    hashes = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _LENGTH))
    for at in range(8, LONG, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        block = eight[starts[more] + at] & _MASKS[np.minimum(size[more] - at, 8)]
        hashes[more] = mix(hashes[more] * _COMBINE + block)
    for i in np.flatnonzero(size > LONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(raw[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (length n - k + 1),
    put together from runs of 1, 2, 4, ... words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, level, span = None, 0, words, 1
    while True:
        if k & span:
            piece = level[at:at + n]
            out = piece if out is None else mix(out * _COMBINE + piece)
            at += span
        if 2 * span > k:
            return mix(out ^ np.uint64(k))
        level = mix(level[:-span] * _COMBINE + level[span:])
        span *= 2


def batches(it, limit_bytes: int = 16 << 20):
    """Re-slice Arrow batches so that the ``text`` bytes of one slice stay
    near ``limit_bytes`` (a longer document is a slice of its own)."""
    for batch in it:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column("text"))
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(offsets, offsets[a] + limit_bytes, side="right")) - 1
            b = min(max(b, a + 1), batch.num_rows)
            yield batch.slice(a, b - a)
            a = b
