"""Words of whole texts as positions in their bytes, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cohortspark.llm._words import mix

_BASE = 0x100000001B3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def kinds(blank: bytes, ends: bytes = b"") -> np.ndarray:
    """What each byte is: 0 part of a word, 1 between words, 2 the end of a piece."""
    out = np.zeros(256, dtype=np.uint8)
    out[list(blank)], out[list(ends)] = 1, 2
    return out


class Words:
    """The words of all texts of an Arrow array, A-Z lower-cased: their bytes, where they stand, their text and piece."""

    def __init__(self, texts: pa.Array, kind_of: np.ndarray):
        at = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
        data = texts.buffers()[2]
        self.data = _LOWER[np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]] if data is not None else np.zeros(0, dtype=np.uint8)
        at = at - at[0]
        kind = kind_of[self.data]
        own = kind == 0
        before, after = np.concatenate([[False], own])[:-1], np.concatenate([own, [False]])[1:]
        filled = at[:-1][np.diff(at) > 0]
        before[filled] = False
        after[filled[1:] - 1] = False
        self.start, self.end = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        breaks = np.cumsum(kind == 2)[self.start] if len(self.start) else np.zeros(0, dtype=np.int64)
        #: Whether a word and the next one stand in one piece of one text.
        self.joined = (self.text[1:] == self.text[:-1]) & (breaks[1:] == breaks[:-1])
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.bytes, self.size = self.data[own], self.end - self.start

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from its bytes."""
        return hash_stretches(self.bytes, np.concatenate([[0], np.cumsum(self.size)]))

    def array(self) -> pa.Array:
        """The words as an Arrow array."""
        ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self.size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.bytes))])

    def coded(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """A number for each word, the distinct words and their hashes."""
        words = self.array().dictionary_encode()
        known = words.dictionary
        at = np.frombuffer(known.buffers()[1], dtype=np.int64, count=len(known) + 1) if len(known) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(known.buffers()[2], dtype=np.uint8)[: at[-1]] if len(known) else np.zeros(0, dtype=np.uint8)
        return words.indices.to_numpy().astype(np.int64), known, hash_stretches(data, at)


def hash_stretches(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes between two positions (its sum of bytes times powers of its places, mixed)."""
    if len(at) < 2:
        return np.zeros(0, dtype=np.uint64)
    size = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    power = np.ones(int(size.max(initial=1)), dtype=np.uint64)
    power[1:] = np.uint64(_BASE)
    term = (data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[place]
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(term)])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64))
