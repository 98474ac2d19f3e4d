"""Words of whole texts as 64-bit hashes in flat numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(texts: pa.Array, most: int = 4_000_000):
    """Runs of rows of about ``most`` bytes."""
    lo = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat words (runs of anything but ASCII white space) and n + 1 offsets; null has none."""
    raw = pc.fill_null(texts, "").cast(pa.large_string())
    lists = pc.ascii_split_whitespace(raw)
    flat = lists.flatten()
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        flat = flat.filter(pa.array(full))
    return flat, at.astype(np.int64)


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z folded, every other byte left alone (Arrow's ascii_lower changes bytes beyond ASCII)."""
    raw = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = raw.buffers()
    folded = pa.py_buffer(data.to_pybytes().lower() if data is not None else b"")
    return pa.LargeStringArray.from_buffers(len(raw), offsets, folded, offset=raw.offset)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word, and n + 1 offsets. ``lower`` folds A-Z alone."""
    flat, at = split_words(lowered(texts) if lower else texts)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64), at


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(3) + h[i : len(h) - n + 1 + i])
    return out


def long_grams(h: np.ndarray, n: int) -> np.ndarray:
    """As grams, in log n steps: the n-word hash from hashes of powers of two words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    power, step, at, out = h, 1, 0, np.zeros(size, np.uint64)
    while True:
        if n & step:
            out = mix(out * np.uint64(3) + power[at : at + size])
            at += step
        step *= 2
        if step > n:
            return out
        power = mix(power[: len(power) - step // 2] * np.uint64(5) + power[step // 2 :])
