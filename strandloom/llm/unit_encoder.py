"""Exact BPE encoding with a cache of units.

A text is cut before every single space that a non-space character follows, at
line feeds between non-space characters, and before ASCII punctuation that
stands between a letter and a space.  Neither of the pre-tokenisers used here
lets a match cross such a place, or look further than the next character, so
the ids of a text are the ids of its units put one after the other.  Cutting
and finding the distinct units of many texts is done by Arrow; each distinct
unit is then encoded once, several times faster than running text.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands before a unit that has no space before it.
_GLUED = "\x01"
#: Units of Latin letters alone.
_PLAIN = re.compile(_GLUED + "?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Texts with such places are cut at single spaces only, by Python: space runs, spaces at line
#: ends, three line feeds, other white space or controls, and what may be a special token.
_ODD = (
    r"  | \n|\n |\n\n\n|\n\n\z| \z|<\||[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_CUT = re.compile(r" (?=\S)")
#: Text that one call of the encoder handles: enough to meet most units often, little enough to hold.
SLICE_BYTES = 2_400_000
#: Letters whose lower case is a letter, and punctuation but the apostrophe, which may begin a contraction.
_PUNCTUATION = r"([a-zA-Z\p{Ll}\p{Lo}])([!-&(-/:-@\[-`{-~]+)( |\z)"


class _Known:
    """Units and their ids: unit k is ``flat[ends[k] : ends[k + 1]]``."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.ends = np.zeros(1 << 14, dtype=np.int64)

    @staticmethod
    def _fit(array: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(array):
            return array
        grown = np.zeros(max(2 * len(array), used + more), dtype=array.dtype)
        grown[:used] = array[:used]
        return grown

    def add(self, units: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.index)
        used = int(self.ends[known])
        self.flat = self._fit(self.flat, used, len(flat))
        self.flat[used : used + len(flat)] = flat
        self.ends = self._fit(self.ends, known + 1, len(units))
        self.ends[known + 1 : known + 1 + len(units)] = used + np.cumsum(sizes)
        self.index.update(zip(units, range(known, known + len(units))))

    def places(self, units: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at ``places``, flat, and how many each has."""
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        ends = np.cumsum(sizes)
        gather = np.repeat(starts - (ends - sizes), sizes)
        gather += np.arange(len(gather))
        return self.flat[gather], sizes


class UnitEncoder:
    """Encodes texts into one flat id array and per-text lengths.

    ``keep_space``: units carry their leading space (byte-level vocabularies);
    else the tokenizer drops white space, and lower-cases.  ``cache_units``
    bounds the cache: units met again outlive those that are not, as the older
    half is dropped whenever the newer one is full.  It changes speed only.
    """

    def __init__(self, path: str | Path, keep_space: bool, cache_units: int = 800_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_file(str(path))
        self._keep_space = keep_space
        self._cache_units = cache_units
        self._set_up_plain(str(path))
        self._young, self._old = _Known(), _Known()

    def _set_up_plain(self, path: str) -> None:
        """A second tokenizer that takes words in the byte alphabet, cut at spaces.

        It runs the same merges without normaliser and pre-tokeniser, so many
        words go through one call.  Where a word begins (or ends, in a
        vocabulary with word ends) shows in the tokens themselves.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        self._plain = Tokenizer.from_file(path)
        self._plain.normalizer = None
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._plain.get_vocab(with_added_tokens=True)
        self._edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self._edge[number] = token.startswith("Ġ") if self._keep_space else token.endswith("</w>")
        self._space = vocabulary.get("Ġ")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self._alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def _in_bytes(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._alphabet)

    def _run_plain(self, shown: list[str], between: str) -> np.ndarray:
        rows = [between.join(shown[k : k + 500]) for k in range(0, len(shown), 500)]
        made = self._plain.encode_batch_fast(rows, add_special_tokens=False)
        return np.fromiter(chain.from_iterable(e.ids for e in made), np.uint32)

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words of Latin letters and how many each has."""
        if not self._keep_space:
            flat = self._run_plain([self._in_bytes(w.lower()) for w in words], " ")
            bounds = np.append(0, np.flatnonzero(self._edge[flat]) + 1)
        else:
            flat = self._run_plain(["Ġ" + self._in_bytes(w) for w in words], " ")
            bounds = np.append(np.flatnonzero(self._edge[flat]), len(flat))
        if len(bounds) != len(words) + 1:
            raise RuntimeError("words and tokens do not match")
        return flat, np.diff(bounds)

    def _glued_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without a space before them; a lone space token parts them."""
        flat = self._run_plain(["Ġ " + self._in_bytes(w) for w in words], " ")
        alone = flat == self._space
        starts = np.flatnonzero(alone)
        if len(starts) != len(words):
            raise RuntimeError("words and tokens do not match")
        return flat[~alone], np.diff(np.append(starts, len(flat))) - 1

    def _hard_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self._keep_space:
            units = [u[1:] if u[:1] == _GLUED else " " + u for u in units]
        rows = [e.ids for e in self._tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(chain.from_iterable(rows), np.uint32, int(sizes.sum())), sizes

    def _learn(self, units: list[str]) -> None:
        plain, glued, hard = [], [], []
        for u in units:
            if not _PLAIN(u) or (u[0] == _GLUED and not self._keep_space):
                hard.append(u)
            elif u[0] == _GLUED:
                glued.append(u)
            else:
                plain.append(u)
        for group, encode in ((plain, self._plain_ids), (glued, lambda g: self._glued_ids([u[1:] for u in g])), (hard, self._hard_ids)):
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                self._young.add(part, *encode(part))

    def _places(self, units: list[str]) -> np.ndarray:
        """Places in the newer half of distinct units, which all get one."""
        if self._young.index and len(self._young.index) + len(units) > self._cache_units // 2:
            self._old, self._young = self._young, _Known()
        at = self._young.places(units)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [units[i] for i in missing.tolist()]
            before = self._old.places(unknown)
            again = before >= 0
            if again.any():
                self._young.add([u for u, k in zip(unknown, again.tolist()) if k], *self._old.ids(before[again]))
            self._learn([u for u, k in zip(unknown, again.tolist()) if not k])
            at[missing] = self._young.places(unknown)
        return at

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Lists of units; a text without any characters may have an empty unit."""
        if not self._keep_space:
            flat = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            return pc.split_pattern(pc.replace_substring_regex(flat, _PUNCTUATION, r"\1 \2\3"), " ")
        glued = pc.binary_join_element_wise(pa.scalar(_GLUED), pc.replace_substring(texts, "\n", f" {_GLUED}\n {_GLUED}"), "")
        return pc.split_pattern(pc.replace_substring_regex(glued, _PUNCTUATION, rf"\1 {_GLUED}\2\3"), " ")

    def _cut_odd(self, texts: list[str]) -> pa.ListArray:
        mark = _GLUED if self._keep_space else ""
        # A text that holds the mark itself is one unit.
        return pa.array([[mark + t] if _GLUED in t else _CUT.split(mark + t) for t in texts], pa.list_(pa.string()))

    def _encode(self, cut: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        coded = cut.flatten().dictionary_encode()
        places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        flat, sizes = self._young.ids(places)
        before = np.concatenate(([0], np.cumsum(sizes)))
        bounds = np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy())))
        return flat, before[bounds[1:]] - before[bounds[:-1]]

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of all texts, none of them null, and the number of ids of each."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return np.empty(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._encode(self._cut(texts))
        if odd.all():
            return self._encode(self._cut_odd(texts.to_pylist()))
        counts = np.zeros(len(texts), dtype=np.int64)
        parts = [self._encode(c) for c in (self._cut(texts.filter(pa.array(~odd))), self._cut_odd(texts.filter(pa.array(odd)).to_pylist()))]
        for which, (_, own) in zip((~odd, odd), parts):
            counts[which] = own
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), dtype=np.uint32)
        for which, (flat, own) in zip((~odd, odd), parts):
            starts = (ends - counts)[which]
            spots = np.repeat(starts - (np.cumsum(own) - own), own)
            spots += np.arange(len(flat))
            out[spots] = flat
        return out, counts


def worker_encoder(path: str | Path, keep_space: bool) -> UnitEncoder:
    """The encoder of this Python worker, kept for the next task that it runs.

    Spark reuses workers but unpickles a task's functions anew, so the cache
    hangs on the tokenizer library's module, which lives as long as the worker.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_unit_encoders", {})
    key = (str(path), keep_space)
    if key not in held:
        held.clear()  # one vocabulary at a time bounds the worker's memory
        held[key] = UnitEncoder(path, keep_space)
    return held[key]
