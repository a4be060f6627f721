"""Benchmark decontamination by template canonicalisation.

Words lose case and outer punctuation; numbers, names and units become typed placeholders, whose
words are kept as slot values. Windows of ``window`` template words of every document are joined
by hash with those of the benchmark. A document leaks an item where windows that follow one
another cover enough of the item and its slots agree: each value of the item stands for one value
in the document, and different values for different ones. So a question asked again with other
numbers or names is found, while texts that only share a turn of phrase are not. Windows of an
item with few words outside placeholders say too little as templates: those are joined by the
words themselves, so a copy of an item that is all numbers, names and units is found, too.

The benchmark goes to the executors in blocks of at most ``block`` windows, one pass a block, so
what is broadcast is bounded whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.llm.common import TEXT_ROWS, release, written
from tidemark.llm.encoding import chunks

WINDOW, COVER, LITERALS = 8, 0.6, 4
NUMBER, NAME, UNIT = 1, 2, 3
_NUMBER = re.compile(r"[+-]?[0-9][0-9.,:/]*(?:[a-zµ°]{1,3}|%)?")
_STRIP = re.compile(r"^[^\w%$€£]+|[^\w%°]+$|[$€£]")
_TITLE = re.compile(r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+")
# Words that stand for numbers and units.
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice".split())
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi ft yd inch inches feet foot mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds liter liters litre litres ml l gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years mph kmh dollar dollars cent cents euro euros usd eur % percent degrees degree °c °f celsius fahrenheit watt watts volt volts mb gb tb".split())
# Given names that are names at the start of a sentence, too.
GIVEN_NAMES = frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen daniel lisa matthew nancy anthony betty mark sandra paul emily steven anna andrew emma kevin olivia brian sophia george tom tim sam ben alice bob carol dave eve jack jane kate luke maria peter lucy natalia weng ken josh wendi carlos juan pedro jose luis ana marie jean pierre hans klaus anke".split())


def read_word(word: str) -> tuple[int, int, int]:
    """(hash of the literal, placeholder or 0, flags: 1 title case, 2 ends a sentence, 4 no word)."""
    bare = _STRIP.sub("", word)
    low = bare.lower()
    flags = (2 if word.rstrip("\"')]»”")[-1:] in (".", "!", "?", ":") else 0) | (0 if low else 4)
    kind = NUMBER if _NUMBER.fullmatch(low) or low in NUMBER_WORDS else UNIT if low in UNITS else 0
    if not kind and _TITLE.fullmatch(bare):
        flags |= 1
        kind = NAME if low in GIVEN_NAMES else 0
    return xxhash.xxh64_intdigest(low, 7), kind, flags


class Templates:
    """Template words of texts, many at once: each distinct word is read once a batch."""

    def __init__(self, window: int) -> None:
        self.window, self._read = window, {}

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Template hash and own hash of each word, its placeholder, each text's range of words, and the words."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self._read) > 200_000:
            self._read.clear()
        read = self._read
        for w in words:
            if w not in read:
                read[w] = read_word(w)
        h = np.fromiter((read[w][0] for w in words), np.uint64, len(words))
        kind = np.fromiter((read[w][1] for w in words), np.int8, len(words))
        flags = np.fromiter((read[w][2] for w in words), np.int8, len(words))
        codes = coded.indices.to_numpy()
        kind, flags, h = kind[codes], flags[codes], h[codes]
        edges = lists.offsets.to_numpy().astype(np.int64)
        opens = np.ones(len(codes) + 1, bool)
        opens[1:] = flags & 2 != 0
        opens[edges] = True
        kind = np.where((kind == 0) & (flags & 1 != 0) & ~opens[:-1], np.int8(NAME), kind)
        own = flags & 4 == 0
        kept = np.concatenate(([0], np.cumsum(own)))
        return np.where(kind > 0, kind.astype(np.uint64), h)[own], h[own], kind[own], kept[edges], lists.values.filter(pa.array(own))

    def windows(self, h: np.ndarray, size: int) -> np.ndarray:
        n = max(0, len(h) - size + 1)
        w = np.zeros(n, np.uint64)
        for k in range(size):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        return w ^ w >> np.uint64(31)


class Index:
    """Template windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, cover: float = COVER) -> None:
        self.templates, self.cover, self.size = Templates(window), cover, window
        h, plain, kind, edges, words = self.templates.of([t for _, t in items])
        self.words, self.kinds, self.ids = words.to_pylist(), kind, [i for i, _ in items]
        self.starts, self.lens = edges[:-1], np.diff(edges)
        # items shorter than the window are one window of their own length
        found: list[list[tuple[np.ndarray, np.ndarray, int, int]]] = [[], []]  # by template, by the words themselves
        for k, (s, n) in enumerate(zip(self.starts.tolist(), self.lens.tolist())):
            if n < LITERALS:
                continue
            own = min(window, n)
            rich = np.convolve(kind[s : s + n] == 0, np.ones(own, int), "valid") >= min(LITERALS, own)
            for to, x, ok in zip(found, (h, plain), (np.flatnonzero(rich), np.flatnonzero(~rich))):
                to.append((self.templates.windows(x[s : s + n], own)[ok], ok, k, own))
        self.tables = [self._table(x) for x in found]

    @staticmethod
    def _table(found: list[tuple[np.ndarray, np.ndarray, int, int]]) -> tuple[np.ndarray, ...]:
        """Hashes in order, and the place, the item and the size of each window."""
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        hashes, places = cat([w for w, _, _, _ in found], np.uint64), cat([at for _, at, _, _ in found], np.int64)
        n = [len(at) for _, at, _, _ in found]
        owners, size = (np.repeat(np.array([f[c] for f in found], np.int64), n) for c in (2, 3))
        order = np.lexsort((places, owners, hashes))
        return hashes[order], places[order], owners[order], size[order]

    def leaks(self, texts: list[str]) -> list[list[tuple[int, float, int, int]]]:
        """For each text its leaked items: (item id, share covered, slots, slots with other values)."""
        h, plain, kind, edges, words = self.templates.of(texts)
        hits: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for own, (hashes, places, owners, size_of) in zip((h, plain), self.tables):
            for size in np.unique(size_of).tolist():
                w = self.templates.windows(own, size)
                lo = np.searchsorted(hashes, w, side="left")
                found = np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == w)
                if not len(found):
                    continue
                text = np.searchsorted(edges, found, side="right") - 1
                inside = found + size <= edges[text + 1]
                for p, t in zip(found[inside].tolist(), text[inside].tolist()):
                    k = int(lo[p])
                    while k < len(hashes) and hashes[k] == w[p]:
                        if size_of[k] == size:
                            hits.setdefault((t, int(owners[k])), []).append((p, int(places[k]), size))
                        k += 1
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in texts]
        for (t, item), pairs in sorted(hits.items()):
            if best := self._check(item, pairs, words, int(edges[t])):
                out[t].append((self.ids[item], *best))
        return out

    def _check(self, item: int, pairs: list[tuple[int, int, int]], words: pa.Array, base: int) -> tuple[float, int, int] | None:
        n, start = int(self.lens[item]), int(self.starts[item])
        by: dict[int, list[tuple[int, int]]] = {}
        for p, q, size in pairs:  # one alignment of the item with the text has one difference of places
            by.setdefault(p - q, []).append((q, size))
        runs = sorted(by.items())
        best = None
        for a in range(len(runs)):  # alignments that differ by a few words inserted or left out go together
            covered, values, ok = np.zeros(n, bool), {}, True
            for shift, found in runs[a:]:
                if shift - runs[a][0] > max(2, n // 10):
                    break
                for q, size in found:
                    covered[q : q + size] = True
                    for x in range(q, q + size):
                        if self.kinds[start + x]:
                            values[x] = (self._bare(self.words[start + x]), self._bare(words[shift + x].as_py()))
            share = float(covered.mean())
            if share < self.cover:
                continue
            there, back = {}, {}
            for x, y in values.values():
                ok &= there.setdefault(x, y) == y and back.setdefault(y, x) == x
            if ok and (best is None or share > best[0]):
                best = (share, len(values), sum(x != y for x, y in values.values()))
        return best

    @staticmethod
    def _bare(word: str) -> str:
        return _STRIP.sub("", word).lower()


def blocks(benchmark: DataFrame, window: int, cover: float, block: int) -> Iterator[Index]:
    """Indexes over the benchmark, each of at most about ``block`` windows; null rows are left out."""
    items, n = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        items.append((r.item_id, r.text))
        n += len(r.text) // 2 + 1
        if n >= block:
            yield Index(items, window, cover)
            items, n = [], 0
    if items:
        yield Index(items, window, cover)


def _search(sent: Broadcast, names: list[str]):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = [(ids[a + k], *x) for a, b in chunks(texts) for k, own in enumerate(sent.value.leaks(texts[a:b])) for x in own]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=names)

    return search


def _clean(sent: Broadcast):
    def clean(text: pd.Series) -> pd.Series:
        texts = [x or "" for x in text]
        out = pd.Series([not own for a, b in chunks(texts) for own in sent.value.leaks(texts[a:b])], dtype=bool)
        release()
        return out

    return F.pandas_udf(clean, BooleanType())


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, block: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, coverage, slots, changed) for each leaked item of each row of ``documents``.

    coverage is the share of the item's words that is found, changed the number of slots whose
    values differ from the item's. Case is ignored, but names are known by theirs: a copy all in
    capitals is found by the windows that hold no name. Null texts, and items of fewer than four words, leak nothing.
    Items of one id are checked text by text. Repeated rows are found each. Other columns are
    ignored, whatever their names. Empty tables give an empty result.
    """
    spark, schema = documents.sparkSession, "doc_id long, item_id long, coverage double, slots int, changed int"
    names = [x.split()[0] for x in schema.split(", ")]
    rows, out = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for index in blocks(benchmark, window, cover, block):
        sent = spark.sparkContext.broadcast(index)
        own = written(rows.mapInArrow(_search(sent, names), schema), "leaks")
        sent.destroy()
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, block: int = 4_000_000) -> DataFrame:
    """The rows of ``documents`` that leak no item, with their columns and no others."""
    spark, columns, clean = documents.sparkSession, [F.col(f"`{c}`") for c in documents.columns], documents
    for index in blocks(benchmark, window, cover, block):
        sent = spark.sparkContext.broadcast(index)
        marked = clean.select(F.struct(*columns).alias("row")).where(_clean(sent)(F.col("row.text")))
        clean = written(marked.select("row.*"), "clean", TEXT_ROWS)  # so one block is out at a time
        sent.destroy()
    return clean
