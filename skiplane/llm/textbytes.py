"""Vectorised work on the UTF-8 bytes of an Arrow string column.

Nothing here makes Python strings: a batch of texts is one byte buffer with
offsets, and words are spans of it. The hash of a word mixes eight bytes at a
time with what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: The odd multipliers of byte values and of the word windows, and
#: the constants of the 64-bit finaliser (Stafford's variant 13).
BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

_U = np.uint64

#: The lowest 0 to 8 bytes of eight.
KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(MIX_A)
    x = (x ^ (x >> _U(27))) * _U(MIX_B)
    return x ^ (x >> _U(31))


def byte_values(seed: int) -> np.ndarray:
    """A random-looking odd 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(BASE) + _U(seed)) | _U(1)


def byte_class(members: str | bytes) -> np.ndarray:
    """Boolean table of 256 entries, true for the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(members.encode("latin-1") if isinstance(members, str) else members)] = True
    return out


#: Bytes outside [\x20\x09-\x0D].
BLANK_SEPARATED = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
ALPHANUMERIC = ~byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

class Texts:
    """Bytes of a batch of texts: ``data`` and ``starts`` (one more than texts). Null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_large_string(column.type):
            wide = np.int64
        else:
            column, wide = column.cast(pa.string()), np.int32
        column = column.fill_null("") if column.null_count else column
        n = len(column)
        bounds = np.frombuffer(column.buffers()[1], dtype=wide, count=n + 1, offset=column.offset * wide().itemsize) if n else np.zeros(1, wide)
        raw = column.buffers()[2] if n else None
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[int(bounds[0]) : int(bounds[-1])]
        self.starts = bounds.astype(np.int64) - int(bounds[0])

    def __len__(self) -> int:
        return len(self.starts) - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each maximal run of ``inside`` bytes within a text, and for each text the place of its first word (one more than texts)."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        on = inside[self.data]
        begins = on.copy()
        begins[1:] &= ~on[:-1]
        cut = self.starts[:-1][self.starts[:-1] < n]
        begins[cut] = on[cut]
        ends = on.copy()
        ends[:-1] &= ~on[1:]
        last = self.starts[1:][self.starts[1:] > 0] - 1
        ends[last] = on[last]
        first = np.flatnonzero(begins)
        return first, np.flatnonzero(ends) + 1, np.searchsorted(first, self.starts)

    def word_hashes(self, start: np.ndarray, end: np.ndarray, seed: int, fold_case: bool = False) -> np.ndarray:
        """Hash of the bytes of each span, eight at a time, each mixed with what came before; A-Z like a-z on request."""
        data = np.zeros(len(self.data) + 8, dtype=np.uint8)
        data[:-8] = LOWER[self.data] if fold_case else self.data
        eight = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=data, strides=(1,))
        left, at = end - start, start
        out = mix(left.astype(np.uint64) + _U(seed))
        some = np.arange(len(start))
        while len(some):
            n = np.minimum(left, 8)
            chunk = eight[at] & KEPT[n]
            out[some] = mix(out[some] * _U(STEP) + mix(chunk ^ _U(BASE)))
            more = left > 8
            some, at, left = some[more], at[more] + 8, left[more] - 8
        return out


def windows(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, by the place of its first word; shorter by size - 1."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _U(STEP) + word_hash[k : k + n]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair of start and count, one after the other."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.repeat(np.asarray(starts, dtype=np.int64) - first, counts) + np.arange(total)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each hold about ``most_bytes`` at most; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
