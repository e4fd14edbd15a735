"""Vectorised kernels over Arrow text columns: words, hashes, shingles.

A word is a run of bytes outside [\\x20\\x09-\\x0D] of the UTF-8 text with A-Z lower-cased. Hashes have
64 bits and mix a span's length and its bytes, eight at a time, each step a bijection of what came before:
spans of at most eight bytes with one length never collide, others only by chance, whatever their structure.
A span of more than LONG_SPAN bytes is hashed by XXH3.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Text bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Bytes in which words are counted at once.
CHUNK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_Q = U(0xD6E8FEB86659FD93)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 64
#: Masks of the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    h = h + U((seed * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(29))) * U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings without nulls (null becomes empty)."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most `limit` bytes of text, or one row. At the end, memory that a long-lived worker no longer uses goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets start at 0."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros stand after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each data[start:end]; fold: with A-Z lower-cased."""
    if not len(starts):
        return np.empty(0, U)
    data = LOWER[data] if fold else data
    at = eights(data)
    sizes = ends - starts
    hashes = sizes.astype(U) * U(0x8CB92BA72F3D8DD7)
    place, here = np.arange(len(starts)), starts
    left = np.where(sizes > LONG_SPAN, 0, sizes)
    while len(place):
        if not left.all():
            keep = np.flatnonzero(left)
            place, here, left = place[keep], here[keep], left[keep]
        hashes[place] = mix(hashes[place] ^ (at[here] & FIRST_BYTES[np.minimum(left, 8)]))
        here, left = here + 8, np.maximum(left - 8, 0)
    for k in np.flatnonzero(sizes > LONG_SPAN).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return mix(hashes, 5)


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span whose number stands in others."""
    sizes = ends - starts
    same = sizes == sizes[others]
    at = eights(data)
    place = np.flatnonzero(same & (others != np.arange(len(others))))
    here, there, left = starts[place], starts[others[place]], sizes[place]
    while len(place):
        equal = (at[here] ^ at[there]) & FIRST_BYTES[np.minimum(left, 8)] == 0
        same[place[~equal]] = False
        more = np.flatnonzero(equal & (left > 8))
        place, here, there, left = place[more], here[more] + 8, there[more] + 8, left[more] - 8
    return same


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of texts that lie one after the other."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    edge[1:] |= blank
    first = ~blank & edge[:-1]
    edge[:] = False
    edge[offsets] = True
    edge[:-1] |= blank
    last = ~blank & edge[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    data, offsets = raw(texts)
    if not len(data):
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    starts, ends = word_spans(data, offsets)
    return span_hashes(data, starts, ends, fold=True), np.diff(np.searchsorted(starts, offsets))


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, chunk by chunk, so that a long text needs no arrays of its own length."""
    data, offsets = raw(texts)
    counts = np.zeros(len(texts), np.int64)
    for at in range(0, len(data), CHUNK):
        blank = SPACE[data[at : at + CHUNK]]
        first = ~blank
        first[1:] &= blank[:-1]
        # A text's first byte begins a word whatever lies before it.
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(blank))] - at
        first[begins] |= ~blank[begins]
        if at and not SPACE[data[at - 1]] and not (len(begins) and begins[0] == 0):
            first[0] = False
        own, times = np.unique(np.searchsorted(offsets, np.flatnonzero(first) + at, side="right") - 1, return_counts=True)
        counts[own] += times
    return counts


def group_index(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), starts[1], ..."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def shingles(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words, runs of each text), repeated runs included; a shorter text is one run."""
    starts = np.cumsum(counts) - counts
    sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    rolled = np.zeros(len(words), U)
    factors = np.cumprod(np.full(k, _Q))
    for j in range(k):
        rolled[: len(words) - j] += words[j:] * factors[j]
    out = rolled[group_index(starts, sizes)]
    at = np.cumsum(sizes) - sizes
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        n = int(counts[d])
        out[at[d]] = (words[starts[d] : starts[d] + n] * factors[:n]).sum() ^ U(n)
    return mix(out, 1), sizes


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one text after the other; set sizes)."""
    flat, sizes = shingles(*word_hashes(texts), k)
    ends = np.cumsum(sizes)
    for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        flat[s:e].sort()
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[(ends - sizes)[sizes > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[ends] - kept[ends - sizes]
