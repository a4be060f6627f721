"""Token ids by the tokenizers library, with a cache of the units between spaces.

BPE merges never cross a piece, so a text's ids are the ids of its pieces in order. For the two
pre-tokenizers known here, texts of plain Latin characters are cut at spaces by Arrow, distinct
units by the pattern, and only those not yet seen go to the library's model. Any other text, and
any other tokenizer, is encoded by the library as it is. The ids are the same either way.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# Latin-1 letters and ASCII: one code point each under NFC and lower(), and Python's re agrees with
# the library's classes on them.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = rf"[^\t-\r -~{_LETTER}]"
# The two pre-tokenizer patterns, as the tokenizer files state them.
_BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"
_WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]


# Where a cut before each space would part what the byte-level pattern keeps together.
_RUNS = r"[\t-\r ] (?:[\t-\r ]|\z)"


def _byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_characters()
_SPACE = _BYTES[32]


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each range in turn."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


class _Units(dict):
    """Unit (what stands between spaces) -> its place among the units encoded so far; ids lie in one flat array.

    A unit of letters is one piece of the pre-tokenizer; any other is made up of its pieces' ids.
    """

    def __init__(self, model, find) -> None:
        self._tokenize, self._find, self._flat, self._ends = model.tokenize, find, array("I"), array("q", [0])

    def __missing__(self, unit: str) -> int:
        bare = unit[1:] if unit[:1] == " " else unit
        parts = [unit] if bare.isalpha() else self._find(unit)
        flat, ends = self._flat, self._ends
        if parts == [unit]:
            if bare.isascii() and bare.isalnum():
                mapped = unit if bare is unit else _SPACE + bare
            else:
                mapped = unit.encode().decode("latin-1").translate(_BYTES)
            flat.extend([x.id for x in self._tokenize(mapped)])
        else:
            for k in [self[x] for x in parts]:
                flat.extend(flat[ends[k] : ends[k + 1]])
        place = len(ends) - 1
        ends.append(len(flat))
        self[unit] = place
        return place

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self._flat, np.uint32), np.array(self._ends, np.int64)


class Encoder:
    """Encodes batches of texts with one tokenizer file; special tokens' strings are ordinary text."""

    def __init__(self, path: str, units: int = 800_000) -> None:
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._most = units
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self._find, self._words = None, False
        if spec["model"]["type"] == "BPE" and not spec["model"].get("dropout"):
            if norm is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True):
                self._find = re.compile(_BYTE_LEVEL).findall
            elif [x["type"] for x in (norm or {}).get("normalizers", [])] == _WORD_NORMALIZERS and [
                (x["type"], x.get("pattern", {}).get("Regex"), x.get("behavior"), x.get("invert"), x.get("use_regex"), x.get("add_prefix_space"))
                for x in pre.get("pretokenizers", [])
            ] == [("Split", _WORD_SPLIT, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]:
                self._find, self._words = re.compile(_WORDS).findall, True
        self._renew()

    def _renew(self) -> None:
        self._units = _Units(self._tokenizer.model, self._find)

    def _cut(self, texts: list[str]) -> list[bool]:
        """Which texts may be cut here."""
        if self._find is None:
            return [False] * len(texts)
        never = _OTHER if self._words else f"{_OTHER}|{_RUNS}"
        return pc.invert(pc.match_substring_regex(pa.array(texts, pa.string()), never)).to_pylist()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in the texts' order, and each text's number of ids."""
        cut = self._cut(texts)
        if all(cut):
            return self._quick(texts) if texts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        whole = iter(self._tokenizer.encode_batch([x for x, c in zip(texts, cut) if not c], add_special_tokens=False))
        if any(cut):
            ids, counts = self._quick([x for x, c in zip(texts, cut) if c])
            own = iter(np.split(ids, np.cumsum(counts)[:-1]))
        each = [next(own) if c else np.array(next(whole).ids, np.uint32) for c in cut]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def _quick(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Without the collector, which would walk millions of live strings again and again."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that may be cut: at spaces, then by the pattern, each part once."""
        if len(self._units) > self._most:
            self._renew()
        lists = pc.split_pattern(pa.array([x.lower() for x in texts] if self._words else texts, pa.string()), " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy().astype(np.int64)
        if not self._words:  # all but a text's first unit begin with the space before them
            first = lists.values.take(pa.array(edges[:-1])).to_pylist()
            codes[edges[:-1]] = np.arange(len(first)) + len(units)
            units = [" " + x for x in units] + first
        own = np.fromiter(map(self._units.__getitem__, units), np.int64, len(units))
        flat, ends = self._units.tables()
        own = own[codes]
        lens = ends[own + 1] - ends[own]
        ids = flat[_spread(ends[own], lens)]
        return ids, np.diff(np.concatenate(([0], np.cumsum(lens)))[edges])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker and file, so its cache lives as long as the worker."""
    return Encoder(path)


def chunks(texts: list[str | None], chars: int = 8_000_000) -> list[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` characters, one text at least: bounds what is held."""
    out, at, n = [], 0, 0
    for k, x in enumerate(texts):
        n += len(x or "")
        if n >= chars:
            out.append((at, k + 1))
            at, n = k + 1, 0
    if at < len(texts):
        out.append((at, len(texts)))
    return out
