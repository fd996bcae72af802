"""Vectorised word hashing over Arrow string buffers, shared by the text operators.

A *word* here is a maximal run of ASCII letters, digits and bytes >= 0x80, after
case folding of ASCII and of the Latin-1 supplement.  All positions are word
positions.  Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240201)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xD6E8FEB86659FD93
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True
_pow: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit splitmix finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 17, 1 << int(n - 1).bit_length())
        inverse = pow(base, -1, 2**64)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        have = _pow[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


def string_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and the bytes of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buffers = arr.buffers()
    if not len(arr) or buffers[2] is None:
        return np.zeros(len(arr) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = np.int64 if big else np.int32
    offsets = np.frombuffer(buffers[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def chunks(arr, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole texts of about ``limit`` bytes; a longer text comes alone and whole."""
    offsets, data = string_buffers(arr)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters of UTF-8 lead byte 0xC3."""
    out = LOWER[data]
    if len(out) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        b = data[after]
        out[after[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]] += 0x20
    return out


def word_bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and for each text the index of its first word (one more than texts)."""
    inside = np.zeros(len(folded) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[folded]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(folded))])
    if len(cut):  # a word never spans two texts
        cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, offsets)


def hash_words(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal words get equal hashes wherever they stand."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, low + CHUNK_BYTES, side="right")))
        piece = folded[low : int(end[to - 1])]
        up, down = _powers(_BASE, len(piece) + 1)
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * up[:-1], out=total[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def hash_ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n-1 positions have none."""
    if n == 1:
        return words
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(len(words) - n + 1, dtype=np.uint64)
    step = 1 << 18
    for low in range(0, len(out), step):
        part = words[low : min(low + step, len(out)) + n - 1]
        up, down = _powers(_BASE2, len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        m = len(part) - n + 1
        out[low : low + m] = mix((total[n:] - total[:m]) * down[:m])
    return out


def hashed(arr, limit: int = CHUNK_BYTES):
    """(first row, folded bytes, word starts, word ends, first word of each text, word hashes) by chunk."""
    for row, offsets, data in chunks(arr, limit):
        folded = fold(data)
        start, end, first = word_bounds(folded, offsets)
        yield row, folded, start, end, first, hash_words(folded, start, end)


def word_list(text: str | None) -> list[bytes]:
    """The words of one text, by the same rule."""
    folded = fold(np.frombuffer((text or "").encode(), dtype=np.uint8))
    start, end, _ = word_bounds(folded, np.array([0, len(folded)]))
    raw = folded.tobytes()
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
