"""Texts of an Arrow batch as byte arrays: words, word hashes and shingles without per-word Python.

All functions see whole texts. A null text counts as an empty one.
"""

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20      # texts handled at once; a longer text is a chunk of its own
HASH_BLOCK = 1 << 18       # bytes hashed at once

_rng = np.random.default_rng(20240607)
LETTER_CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LETTER_CODES[65:91] = LETTER_CODES[97:123]          # A-Z hash as a-z
PLACE_FACTORS = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True


def mixed(x):
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column):
    """(bytes, offsets) of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data, offsets, size=CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets) of runs of texts of about `size` bytes.

    Memory of batches that are done goes back to the system, as Python workers live on.
    """
    pa.default_memory_pool().release_unused()
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data, offsets, inside=NOT_SPACE):
    """(starts, ends, counts): maximal runs of `inside` bytes, never across texts."""
    mask = inside[data]
    n = len(mask)
    change = np.zeros(n + 1, bool)
    if n:
        change[1:n] = mask[1:] != mask[:-1]
        change[0] = change[n] = True
    change[offsets] = True
    edges = np.flatnonzero(change[: n + 1])
    starts, ends = edges[:-1], edges[1:]
    keep = mask[starts] if n else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def _powers(base, n):
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data, starts, ends, prefixes=()):
    """64-bit hashes of the words, ASCII letters without case; then one array per prefix length.

    A prefix as long as the word or longer has the word's own hash.
    """
    outs = [np.empty(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    powers, inverse = _powers(BASE, HASH_BLOCK), _powers(BASE_INVERSE, HASH_BLOCK)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + HASH_BLOCK, "right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo > len(powers):      # one very long word
            powers, inverse = _powers(BASE, hi - lo), _powers(BASE_INVERSE, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(LETTER_CODES[data[lo:hi]] * powers[: hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        for out, length in zip(outs, (None, *prefixes)):
            stop = e if length is None else np.minimum(e, s + length)
            out[i:j] = mixed((sums[stop] - sums[s]) * inverse[s] + (stop - s).astype(np.uint64))
        i = j
    return outs if prefixes else outs[0]


def row_of(counts):
    return np.repeat(np.arange(len(counts)), counts)


def shingles(hashes, counts, size):
    """(shingle hashes, counts): runs of `size` words; a shorter text is one run of all its words."""
    first = np.cumsum(counts) - counts
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = row_of(per_row)
    at = np.arange(per_row.sum()) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[rows]
    length = np.minimum(counts, size)[rows]
    out = length.astype(np.uint64)
    for k in range(size):
        use = k < length
        part = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] * PLACE_FACTORS[k] if len(hashes) else out
        out = np.where(use, mixed(out + part), out)
    return out, per_row


def distinct_sorted(values, counts):
    """The distinct values of each row in ascending order, with their counts."""
    values = values.copy()
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    firsts = (ends - counts)[counts > 0]
    keep[firsts] = True
    rows = row_of(counts)[keep]
    return values[keep], np.bincount(rows, minlength=len(counts))


def sets_of(column, size=5, inside=NOT_SPACE):
    """For runs of texts: (first row, last row + 1, sorted distinct shingle hashes, counts)."""
    data, offsets = text_bytes(column)
    for first, last, part, places in chunks(data, offsets):
        starts, ends, counts = words(part, places, inside)
        hashed, n = shingles(word_hashes(part, starts, ends), counts, size)
        yield first, last, *distinct_sorted(hashed, n)
