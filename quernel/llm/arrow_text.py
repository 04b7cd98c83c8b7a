"""Texts of Arrow batches as one byte array with offsets, in slices of bounded size, and vectorised word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_rng = np.random.default_rng(20260101)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """A dict that lives as long as the worker process runs tasks of ``owner``."""
    return _caches.setdefault(owner, {})


def make_room(owner: str = "") -> None:
    """Workers are used again by later stages: drop what other operators have kept in this one, and give memory back."""
    for name, held in _caches.items():
        if name != owner:
            held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def parts(batches, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows; before and afterwards unused memory goes back to the system."""
    make_room()
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
    make_room()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about ``most`` bytes; a longer text is alone."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S30)) * M1
    h = (h ^ (h >> S27)) * M2
    return h ^ (h >> S31)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(max(1, n), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word: a run of bytes other than space and 0x09-0x0D within one text."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | edges[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | edges[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by default after lower-casing A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(len(data), dtype=np.int64)
    shift = np.zeros(len(data), dtype=np.int64)
    shift[starts] = np.diff(starts, prepend=0)
    place -= np.cumsum(shift)
    np.clip(place, 0, None, out=place)
    ink = ~SPACE[data]
    value = BYTE_VALUES[FOLD][data] if fold else BYTE_VALUES[data]
    value = np.where(ink, value * powers(int(place.max()) + 1)[place], np.uint64(0))
    return mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * M2)


def shingles(hashes: np.ndarray, text: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, offsets by text) of each text's runs of ``k`` words; of all its words if they are fewer."""
    n = len(hashes)
    count = np.bincount(text, minlength=rows)
    h, t = [], []
    if n >= k:
        run = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            run = run * BASE + mix(hashes[i : n - k + 1 + i] + np.uint64(i + 1))
        full = text[: n - k + 1] == text[k - 1 :]
        h.append(mix(run)[full])
        t.append(text[: n - k + 1][full])
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        begin = np.searchsorted(text, few)
        whole = np.zeros(len(few), dtype=np.uint64)
        for i in range(k - 1):
            at = np.minimum(begin + i, n - 1)
            whole = np.where(i < count[few], whole * BASE + mix(hashes[at] + np.uint64(i + 1)), whole)
        h.append(mix(whole ^ (count[few].astype(np.uint64) << np.uint64(57))))
        t.append(few)
    if not h:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    if len(h) == 2:  # texts of few words go between the others, so that hashes stay in the order of texts
        at = np.searchsorted(t[0], t[1])
        h, t = np.insert(h[0], at, h[1]), np.insert(t[0], at, t[1])
    else:
        h, t = h[0], t[0]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=rows))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[fresh], t[fresh]
    return h, np.concatenate([[0], np.cumsum(np.bincount(t, minlength=rows))]).astype(np.int64)
