"""Vectorised words and shingles of an Arrow text column, for use inside tasks.

Words are runs of bytes outside white space, A-Z lower-cased, each as a 64-bit polynomial hash that
is computed for a whole chunk of texts at once from running sums: no Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (a longer text is cut at white space).
CHUNK = 1 << 18

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power_table(base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo 2^64; kept, and grown when a longer one is asked for."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.ones(1, np.uint64)
        while len(table) < size:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), 1 << 64))])
        _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; no word crosses a position of ``cuts``."""
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the given spans of ``data``, A-Z lower-cased."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * power_table(_BASE, len(data))[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * power_table(_INVERSE, len(data) + 1)[starts]
    return mix(h)


def _piece(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(data, cuts)
    return span_hashes(data, starts, ends), starts


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, cut at white space into pieces."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(len(data), end + CHUNK)
        out.append(_piece(data[at:end], np.zeros(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)), offsets


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's position, word hashes, and bounds of each text's words."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        if len(part) > CHUNK:
            h = _long(part)
            yield i, h, np.array([0, len(h)])
        else:
            cuts = offsets[i : j + 1] - offsets[i]
            h, starts = _piece(part, cuts)
            yield i, h, np.searchsorted(starts, cuts)
        i = j


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` words in a row within each text, and the bounds of each text's shingles.

    A text of fewer words than ``k`` has one shingle, its whole sequence; one without words has none.
    """
    sizes = np.diff(bounds)
    if not len(h):
        return h, np.zeros(len(bounds), np.int64)
    padded = np.concatenate([h, np.zeros(k - 1, np.uint64)])
    s = np.zeros(len(h), np.uint64)
    for j in range(k):
        s = s * np.uint64(_BASE) + padded[j : j + len(h)]
    inside = np.ones(len(h), bool)
    for j in range(1, k):
        tail = bounds[1:][sizes >= j] - j
        inside[tail] = False
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    for d in short:
        whole = np.uint64(sizes[d])
        for v in h[bounds[d] : bounds[d + 1]]:
            whole = np.uint64((int(whole) * 0xD6E8FEB86659FD93 + int(v)) & 0xFFFFFFFFFFFFFFFF)
        s[bounds[d]] = whole
        inside[bounds[d]] = True
    kept = np.maximum(np.where(sizes > 0, 1, 0), sizes - k + 1)
    return mix(s[inside]), np.concatenate([[0], np.cumsum(kept)])
