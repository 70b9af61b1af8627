"""Words of whole texts as columns: one pass over the bytes of an Arrow batch, no Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BATCH_BYTES = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


@dataclass
class Words:
    """Words of several texts: ``codes`` into ``vocabulary``; text i has ``codes[first[i]:first[i + 1]]``."""

    codes: np.ndarray
    vocabulary: pa.Array
    first: np.ndarray

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of every word."""
        vocabulary = pc.ascii_lower(self.vocabulary) if fold else self.vocabulary
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary.cast(pa.large_binary()).to_pylist()), np.uint64, len(vocabulary))
        return own[self.codes] if len(self.codes) else np.zeros(0, np.uint64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def split_words(texts: pa.Array) -> Words:
    """Runs of bytes other than space and 0x09-0x0D; a null text has none."""
    if not len(texts):
        return Words(np.zeros(0, np.int64), pa.array([], pa.large_utf8()), np.zeros(1, np.int64))
    raw, offsets = _bytes(texts)
    inner = ~((raw == 32) | ((raw - np.uint8(9)) < 5))
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[heads] = inner[heads]  # a text's first byte begins a word whatever stands before it
    narrow = np.int32 if len(raw) < 2**31 else np.int64  # one running count at a time, as narrow as it can be
    counted = np.zeros(len(raw) + 1, narrow)
    np.cumsum(starts, out=counted[1:])
    first = counted[offsets].astype(np.int64)
    begins = np.flatnonzero(starts)
    np.cumsum(inner, out=counted[1:])
    bounds = np.append(counted[begins], counted[-1]).astype(np.int64)
    del counted, starts
    data = raw[inner]
    del inner
    flat = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(data))
    coded = flat.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, first)


def mixed(x: np.ndarray) -> np.ndarray:
    """A full-avalanche finisher for 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of ``length`` consecutive values; run i starts at value i."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if seed:
        hashes = mixed(hashes ^ np.uint64(seed))
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total *= ODD
        total += hashes[i : i + n]
    return mixed(total)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
