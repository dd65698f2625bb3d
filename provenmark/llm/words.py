r"""Words `[^\x20\x09-\x0D]+` of a whole Arrow column at once, as numpy arrays: starts, lengths and 64-bit hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


class Words(NamedTuple):
    first: np.ndarray  # number of words before each text, and all
    starts: np.ndarray  # byte offsets in data
    lengths: np.ndarray
    hashes: np.ndarray  # uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(32))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def split(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    return Words(np.searchsorted(starts, offsets), starts, lengths, hash_spans(data, starts, lengths))


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix(lengths.astype(np.uint64) * _A)
    at, left, which = starts, lengths, None
    while len(at):
        part = view[at] & _MASKS[np.minimum(left, 8)]
        if which is None:
            out = mix((out ^ part) * _A)
        else:
            out[which] = mix((out[which] ^ part) * _A)
        on = left > 8
        which = np.flatnonzero(on) if which is None else which[on]
        at, left = at[on] + 8, left[on] - 8
    return out


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a text, and the text's number; a text with 1 to n - 1 words has one, of all its words."""
    counts = np.diff(words.first)
    h = words.hashes
    if len(h) >= n:
        out = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            out = mix(out * _A + h[k : len(h) - n + 1 + k])
    else:
        out = np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(text[: len(out)] == text[n - 1 :]) if len(out) else np.zeros(0, int)
    values, owners = out[inside], text[inside]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = []
        for i in short:
            x = h[words.first[i]]
            for y in h[words.first[i] + 1 : words.first[i + 1]]:
                x = mix(np.array([x * _A + y]))[0]
            extra.append(mix(np.array([x ^ _B]))[0])
        values, owners = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([owners, short])
    return values, owners


def blocks(offsets: np.ndarray, most: int):
    """Ranges of texts of about `most` bytes together (one text at least)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
