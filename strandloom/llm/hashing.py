"""Hashes of words and of runs of words, vectorised over many texts at once."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads all bits (new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """128-bit hashes of the words of texts, parted by spaces and the ASCII controls 9 to 13.

    Arrow cuts the texts and finds their distinct words, byte for byte; each of
    those is hashed once by keyed BLAKE2b, so no word can be made to meet
    another by arithmetic.  ``seed`` is the key.  :meth:`short` has 64 bits by
    keyed SipHash, a whole array of words at a time.
    """

    def __init__(self, seed: int = 1, lower: bool = False):
        self._key, self._lower = seed.to_bytes(8, "little"), lower

    def halves(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both 64-bit halves of all words' hashes, and where each text's words begin (one more at the end)."""
        cut = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        key = self._key
        made = b"".join([blake2b(w, digest_size=16, key=key).digest() for w in distinct])
        hashes = np.frombuffer(made, dtype="<u8").reshape(-1, 2)
        codes = coded.indices.to_numpy()
        inside = codes != distinct.index(b"") if b"" in distinct else np.ones(len(codes), dtype=bool)
        before = np.concatenate(([0], np.cumsum(inside)))
        bounds = before[np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy())))]
        codes = codes[inside]
        return hashes[codes, 0], hashes[codes, 1], bounds

    def _cut(self, texts: pa.Array | list[str]) -> pa.Array:
        """The words of each text, with empty ones where separators meet."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.replace_substring_regex(texts, r"[\t-\r]", " ")
        return pc.split_pattern(pc.ascii_lower(texts) if self._lower else texts, " ")

    def short(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of 64 bits of all words, and the bounds of :meth:`halves`."""
        cut = self._cut(texts)
        words = cut.flatten()
        inside = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate(([0], np.cumsum(inside.to_numpy(zero_copy_only=False))))
        bounds = before[np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy())))]
        words = words.filter(inside).cast(pa.binary()).to_numpy(zero_copy_only=False)
        return hash_array(words, hash_key=self._key.hex(), categorize=False), bounds

    def words(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first halves and the bounds of :meth:`halves`."""
        first, _, bounds = self.halves(texts)
        return first, bounds


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive words (also across texts)."""
    if len(words) < length:
        return np.empty(0, dtype=np.uint64)
    step = _ODD[which]
    done, total, power = 0, None, words
    size, factor, rest = 1, step, length
    while rest:
        if rest & 1:
            if total is None:
                total, done = power, size
            else:
                head = total[: len(words) - done - size + 1] * np.uint64(factor)
                total, done = head + power[done : done + len(head)], done + size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * np.uint64(factor) + power[size:]
            size, factor = 2 * size, factor * factor % (1 << 64)
    return mix(total)


def run_starts(bounds: np.ndarray, length: int) -> np.ndarray:
    """Indices of the words at which a run of ``length`` words of one text begins."""
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    first = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(len(first))
