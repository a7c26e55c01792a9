"""Words and five-word shingles of whole texts, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Shingle length in words.
SHINGLE = 5
#: Odd multipliers, one for each place in a shingle.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Texts and bytes of text that are taken at once; one longer text is taken alone.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[slice]:
    """Ranges of rows with at most SLICE_ROWS rows and SLICE_BYTES bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        before = size[start - 1] if start else 0
        stop = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right"))), n)
        yield slice(start, stop)
        start = stop


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts (A-Z lower-cased), and the bounds of each text."""
    from pandas.util import hash_array

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    at, bounds = coded.indices.to_numpy(), bounds - bounds[0]
    blank = np.flatnonzero(words == "")  # before or after the words of a text
    if len(blank):
        real = at != blank[0]
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        at = at[real]
    return hash_array(words, categorize=False)[at], bounds


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the five-word shingles of each text in ascending order, and the bounds of each text.

    Fewer words make one shingle, none make none.
    """
    h, bounds = word_hashes(texts)
    count = np.diff(bounds)
    made = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(ends[-1], dtype=np.uint64)
    if len(h) >= SHINGLE:
        full = len(h) - SHINGLE + 1
        all_runs = mix(sum(h[k : full + k] * _PLACE[k] for k in range(SHINGLE)))
        first = np.repeat(np.where(count >= SHINGLE, bounds[:-1] - ends[:-1], 0), made)
        of_long = np.repeat(count >= SHINGLE, made)
        out[of_long] = all_runs[(np.arange(len(out)) + first)[of_long]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        v = np.full(len(short), n, dtype=np.uint64)
        for k in range(n):
            v = mix(v * _PLACE[0] + h[bounds[short] + k])
        out[ends[short]] = v
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), dtype=bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[ends[:-1][made > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]
