"""Suffix-array dedup: passages of ``least`` words or more that occur in more than one document.

1. Suffixes are kept only where content selects them: at the minimiser (the first of equal ones) of
   each run of windows of ``GRAM`` words. Any passage of ``least`` words holds a whole run, so all
   its occurrences keep the suffix at the same place of the passage.
2. A suffix whose first ``GRAM`` words stand in one text alone matches nothing; least and greatest
   text hash by hash, formed before the shuffle, drop those. Of equal texts one stands for all:
   each of its documents repeats as a whole, so copies never meet in the array.
3. The rest is sorted as a sparse suffix array: by the words that follow, then by those before.
   The sort is by ranges, so a passage that thousands of documents share is spread over tasks.
4. Each suffix is compared with its nearest neighbours of another document on either side and the
   match extended right and left, up to ``least`` words on either side of the suffix; longer
   passages are made up of the matches of the suffixes along them. A second order, by the words before and
   then those that follow, finds matches whose right side is shared with other documents still.
   Where two tasks' ranges meet, the two outer runs on both sides are compared once more.
5. The neighbours also show how far any match can reach right (first order) and left (second). Where
   such a reach allows a passage that no match has covered, the windows left in doubt are
   compared by hash with those of all suffixes that begin alike. So no window of ``least``
   words that two documents share is missed.
6. Matches of at least ``least`` words are joined into spans, document by document.

Words are runs without ASCII white space, in lower case (A-Z), and compared by 32-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.encoding import chunks

LEAST, GRAM = 50, 13
_PLACE_BITS = 20  # texts are cut in parts of half that many words, which overlap by a passage


class _Words(dict):
    """Word -> 32-bit hash (never 0) of its lower-cased form; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        raw = word.encode().lower()
        self[word] = h = xxhash.xxh32_intdigest(raw, 17) or 1
        return h


@lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (uint32), and each text's first place."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    coded = lists.values.dictionary_encode()
    table = np.fromiter(map(_words().__getitem__, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary))
    own = pc.not_equal(lists.values, "").to_numpy(zero_copy_only=False).astype(bool)
    edges = np.concatenate(([0], np.cumsum(own)))[lists.offsets.to_numpy()]
    return table[coded.indices.to_numpy()][own], edges


def _least_of(x: np.ndarray, size: int, pick) -> np.ndarray:
    """Sliding minimum or maximum over ``size`` places, by doubling."""
    n, step = len(x) - size + 1, 1
    while step * 2 <= size:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[:n], x[size - step : size - step + n])


def anchors(words: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the suffixes that are kept of one text's words."""
    run, places, hashes = least - gram + 1, [], []
    part = 1 << (_PLACE_BITS - 1)
    for a in range(0, max(1, len(words) - least + 1), part):
        w = words[a : a + part + least - 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n = len(w) - gram + 1
        if n < run:
            continue
        h = np.zeros(n, np.uint64)
        for k in range(gram):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w[k : k + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        key = h & ~mask | np.arange(n, dtype=np.uint64)  # of equal grams in one run the first
        low = _least_of(key, run, np.minimum)
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        at = np.unique(low & mask).astype(np.int64)
        places.append(at + a)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    places, first = np.unique(places, return_index=True)
    return places, hashes[first]


def _context(words: np.ndarray, places: np.ndarray, shift: int, step: int, size: int) -> np.ndarray:
    """``size`` words from places + shift on, forward or backward; 0 beyond the text."""
    at = places[:, None] + shift + step * np.arange(size)
    inside = (at >= 0) & (at < len(words))
    return np.where(inside, words[np.clip(at, 0, max(0, len(words) - 1))], np.uint32(0))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first words of two contexts agree, row by row."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], np.argmin(same, axis=1))


_ROW = "h long, right binary, left binary, owner long, whole boolean, doc_id long, tie long, places array<int>"
_MATCH = "kind int, doc_id long, tie long, start int, stop int, other long, reach int, found long"
_SCHEMA = f"{_MATCH}, task int, nth int, {_ROW.replace('doc_id long, tie long, ', '')}"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_ROW_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _offsets(l: np.ndarray, r: np.ndarray, size: int) -> np.ndarray:
    """Bits of the windows a match shows: bit k is the window that begins k words before the suffix."""
    l, r = l.astype(np.uint64), r.astype(np.uint64)
    one = np.uint64(1)
    return ((one << (l + one)) - one) & ~((one << (np.uint64(size) - r)) - one)


def _compare(side: int, first_order: bool, least: int, gram: int):
    """Compares sorted suffixes with their neighbours.

    Rows of kind 0 are matches. Rows of kind 1, by ``side``, are suffixes at the ends of the task's range. Rows
    of kind 2 tell of a suffix how far any match reaches (right in the first order, left in the
    second) and which windows were found, unless these are all that the reach allows.
    """
    size = least - gram
    schema = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in _SCHEMA.split(", ")])

    def rows_of(n: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def matrix(col: pa.ChunkedArray, n: int) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(n, size)

    def single(t: pa.Table) -> pa.Table:
        """Without rows that repeat the one before: they come from rows that repeat id and text."""
        if t.num_rows < 2:
            return t
        again = np.ones(t.num_rows - 1, bool)
        for c in ("h", "owner", "tie"):
            x = t[c].to_numpy()
            again &= x[1:] == x[:-1]
        if not again.any():
            return t
        right, left = matrix(t["right"], t.num_rows), matrix(t["left"], t.num_rows)
        again &= (right[1:] == right[:-1]).all(axis=1) & (left[1:] == left[:-1]).all(axis=1)
        return t.filter(pa.array(np.concatenate(([True], ~again))))

    def compare(t: pa.Table, edges: bool) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """First rows of the runs of one owner, and what was found; ``edges``: the outer runs count as complete."""
        n = t.num_rows
        h, owner, doc, tie = (t[c].to_numpy() for c in ("h", "owner", "doc_id", "tie"))
        turn = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
        runs = np.flatnonzero(turn)
        run = np.cumsum(turn) - 1
        right, left = matrix(t["right"], n), matrix(t["left"], n)
        apart = ~t["whole"].to_numpy()  # texts of several ids repeat as a whole
        rows, starts, stops, others = [], [], [], []
        lists = t["places"].combine_chunks()
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        first = np.cumsum(sizes) - sizes
        reach, found = np.zeros(n, np.int64), np.zeros(n, np.uint64)
        for near in (runs[run] - 1, np.append(runs, n)[run + 1]):
            i = np.flatnonzero((near >= 0) & (near < n) & apart)
            i = i[h[i] == h[near[i]]]
            if not len(i):
                continue
            r, l = _common(right[i], right[near[i]]), _common(left[i], left[near[i]])
            reach[i] = np.maximum(reach[i], r if first_order else l)
            good = r + l >= size
            i, r, l = i[good], r[good], l[good]
            found[i] |= _offsets(l, r, size)
            each = sizes[i]
            at = flat[np.arange(each.sum()) + np.repeat(first[i] - (np.cumsum(each) - each), each)]
            rows.append(np.repeat(i, each))
            starts.append(at - np.repeat(l, each))
            stops.append(at + gram + np.repeat(r, each))
            others.append(np.repeat(doc[near[i]], each))
        out = []
        if rows and len(k := np.concatenate(rows)):
            out.append(rows_of(
                len(k), kind=pa.array(np.zeros(len(k), np.int32)), doc_id=pa.array(doc[k]), tie=pa.array(tie[k]), start=pa.array(np.concatenate(starts)),
                stop=pa.array(np.concatenate(stops)), other=pa.array(np.concatenate(others)),
            ))
        full = np.full(n, size)
        open_ = _offsets(full, reach, size) if first_order else _offsets(reach, full, size)
        doubt = apart & (open_ & ~found != 0) & (edges | (run > 0) & (run < len(runs) - 1))
        if doubt.any():
            k = np.flatnonzero(doubt)
            out.append(rows_of(
                len(k), kind=pa.array(np.full(len(k), 2, np.int32)), tie=pa.array(tie[k]), start=pa.array(flat[first[k]]), h=pa.array(h[k]),
                reach=pa.array(reach[k]), found=pa.array(found[k].view(np.int64)),
            ))
        return runs, out

    def edge(t: pa.Table, task: int, nth: int) -> pa.RecordBatch:
        n = t.num_rows
        own = {c: t[c].combine_chunks() for c in _ROW_NAMES}
        return rows_of(n, kind=pa.array(np.ones(n, np.int32)), task=pa.array(np.full(n, task)), nth=pa.array(np.arange(nth, nth + n)), **own)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rest, first, nth = TaskContext.get().partitionId(), None, True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch]).select(_ROW_NAMES)
            t = single(own if rest is None else pa.concat_tables([rest, own]).combine_chunks())
            runs, out = compare(t, not side)
            yield from out
            if first and side:
                head = t.slice(0, runs[2] if len(runs) > 2 else t.num_rows)
                yield edge(head, task, 0)
                nth = head.num_rows
            first = False
            rest = t.slice(runs[-2]) if len(runs) > 1 else t
        if rest is not None and side:
            yield edge(rest, task, nth)

    return over


def _sorted_matches(suffixes: DataFrame, first_order: bool, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Matches of one order of the suffixes, with those across the borders of tasks, and the rows of kind 2."""
    order = ["right", "left"] if first_order else ["left", "right"]
    placed = suffixes.repartitionByRange("h", *order, "owner", "tie").sortWithinPartitions("h", *order, "owner", "tie")
    found = written(placed.select(*_ROW_NAMES).mapInArrow(_compare(1, first_order, least, gram), _SCHEMA), "matches")
    edges = found.where("kind = 1").select(*_ROW_NAMES, "task", "nth")
    across = written(  # a few rows a task
        edges.repartition(1).sortWithinPartitions("task", "nth").select(*_ROW_NAMES).mapInArrow(_compare(0, first_order, least, gram), _SCHEMA), "across"
    )
    both = found.unionByName(across)
    matches = both.where("kind = 0").select("doc_id", "tie", "start", "stop", "other")
    return matches, both.where("kind = 2").select("tie", "start", "h", "reach", "found")


def _doubtful(right: DataFrame, left: DataFrame, size: int) -> DataFrame:
    """(h, mask): the windows in doubt of the suffixes of each hash, from the rows of kind 2 of both orders.

    A suffix that one order alone has settled has no row there, and is left out.
    """
    null = F.lit(None).cast("int")
    seen = right.select("tie", "start", "h", F.col("reach").alias("r"), null.alias("l"), "found").unionByName(
        left.select("tie", "start", "h", null.alias("r"), F.col("reach").alias("l"), "found")
    )
    each = seen.groupBy("tie", "start", "h").agg(F.max("r").alias("r"), F.max("l").alias("l"), F.bit_or("found").alias("found"))
    one = F.lit(1).cast("long")
    reach = F.expr("shiftleft(1L, l + 1)") - one
    reach = reach.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, {size} - r)") - one))
    left_out = each.where("r is not null and l is not null").select("h", reach.bitwiseAND(F.bitwise_not(F.col("found"))).alias("mask"))
    return left_out.where("mask <> 0").groupBy("h").agg(F.bit_or("mask").alias("mask"))


def _windows(size: int):
    """One row for each suffix and window in doubt: the window's hash, where it begins before the suffix."""
    names = ["h", "w", "owner", "whole", "doc_id", "tie", "places", "before"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            t = pa.Table.from_batches([batch])
            right, left = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint32).reshape(n, size) for c in ("right", "left"))
            mask = t["mask"].to_numpy()
            ahead, back = np.zeros((n, size + 1), np.uint64), np.zeros((n, size + 1), np.uint64)
            for side, out in ((right, ahead), (left, back)):
                for k in range(size):  # hash of the first k + 1 words on that side
                    x = (out[:, k] ^ side[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                    out[:, k + 1] = (x ^ x >> np.uint64(29)) + np.uint64(k + 1)
            for k in range(size + 1):
                own = (mask >> k & 1).astype(bool)
                if k:
                    own &= left[:, k - 1] != 0
                if k < size:
                    own &= right[:, size - k - 1] != 0
                i = np.flatnonzero(own)
                if not len(i):
                    continue
                w = (back[i, k] * np.uint64(0xC2B2AE3D27D4EB4F) ^ ahead[i, size - k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                rows = t.take(pa.array(i)).combine_chunks()
                cols = {c: rows[c].combine_chunks() for c in ("h", "owner", "whole", "doc_id", "tie", "places")}
                cols |= {"w": pa.array(w.view(np.int64)), "before": pa.array(np.full(len(i), k, np.int32))}
                yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return over


def _matches_in_doubt(suffixes: DataFrame, doubt: DataFrame, least: int, gram: int) -> DataFrame:
    """Matches of exactly ``least`` words among all suffixes of the hashes in doubt."""
    near = written(suffixes.join(doubt, "h"), "doubt")
    schema = "h long, w long, owner long, whole boolean, doc_id long, tie long, places array<int>, before int"
    windows = written(near.mapInArrow(_windows(least - gram), schema), "windows")
    shared = windows.groupBy("h", "w").agg(F.min("owner").alias("a"), F.max("owner").alias("b"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = written(shared.where("a <> b").select("h", "w", "low", "high"), "shared_windows")
    hits = written(windows.where("not whole").join(shared, ["h", "w"]), "hits")
    at = hits.select("doc_id", "tie", F.explode("places").alias("place"), "before", F.when(F.col("low") == F.col("doc_id"), F.col("high")).otherwise(F.col("low")).alias("other"))
    start = F.col("place") - F.col("before")
    return at.select("doc_id", "tie", start.cast("int").alias("start"), (start + least).cast("int").alias("stop"), "other")


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins matches, sorted by document and start, that overlap or touch."""
    now: list | None = None
    for batch in batches:
        out: list[list] = []
        for doc, tie, start, stop, other in zip(*[c.to_pylist() for c in batch.columns]):
            if now is not None and now[0] == doc and now[1] == tie and start <= now[3]:
                now[3], now[4] = max(now[3], stop), min(now[4], other)
            else:
                if now is not None:
                    out.append(now)
                now = [doc, tie, start, stop, other]
        if out:
            yield _spans(out)
    if now is not None:
        yield _spans([now])


def _spans(rows: list[list]) -> pa.RecordBatch:
    doc, _, start, stop, other = zip(*rows)
    a, b = np.array(start, np.int32), np.array(stop, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(a), pa.array(b), pa.array(b - a), pa.array(other, pa.int64())],
        names=["doc_id", "start_word", "end_word", "n_words", "other_doc_id"],
    )


def repeated_passages(documents: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, other_doc_id): maximal repeated spans of each document.

    Words are counted from 0, the end is exclusive; other_doc_id is the smallest id among the
    documents the span was compared with. Rows without doc_id or text, and texts shorter than
    ``least`` words, have none. Rows that repeat both id and text count once; texts of one id
    never match each other. Other columns are ignored, whatever their names. An empty table gives
    an empty result. ``least`` is at most ``gram`` + 62.
    """
    size = least - gram
    if not 0 < size <= 62:
        raise ValueError("least must exceed gram, by 62 at most")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in chunks(texts, 2_000_000):
                words, edges = word_hashes(texts[a:b])
                found = [anchors(words[x:y], least, gram) for x, y in zip(edges[:-1], edges[1:])]
                n = np.array([len(p) for p, _ in found])
                rows = pa.array(np.repeat(np.arange(a, b), n))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in range(3)], pa.array(np.repeat(np.diff(edges), n).astype(np.int32)),
                     pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)), pa.array(np.concatenate([h for _, h in found]).view(np.int64))],
                    names=["doc_id", "tie", "tie2", "n_words", "place", "h"],
                )

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts, 500_000):
                words, edges = word_hashes(texts[a:b])
                cols: list[list] = [[] for _ in _ROW_NAMES]
                for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                    places = np.array(batch.column(3)[a + k].values.to_numpy(), np.int64)
                    hashes = batch.column(4)[a + k].values.to_numpy()
                    order = np.argsort(places)
                    places, hashes, own = places[order], hashes[order], words[x:y]
                    doc, tie, whole, owner = (batch.column(c)[a + k].as_py() for c in (0, 1, 5, 6))
                    seen: dict[tuple[int, bytes], list[int]] = {}  # suffixes of one text with one context are one row
                    for c in range(0, len(places), 20_000):
                        p = places[c : c + 20_000]
                        raw = np.concatenate((_context(own, p, gram, 1, size), _context(own, p, -1, -1, size)), axis=1)
                        for q, h, row in zip(p.tolist(), hashes[c : c + 20_000].tolist(), raw):
                            seen.setdefault((h, row.tobytes()), []).append(q)
                    for (h, both), at in seen.items():
                        for c, v in zip(cols, (h, both[: 4 * size], both[4 * size :], owner, whole, doc, tie, at)):
                            c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=_ROW_NAMES)

    kinds = [_KINDS[x.split()[1]] for x in _ROW.split(", ")]
    rows = documents.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.xxhash64(F.lit(1), "text").alias("tie2"), "text"
    )
    kept = written(rows.mapInArrow(keep, "doc_id long, tie long, tie2 long, n_words int, place int, h long"), "anchors")
    texts = written(  # one row a text of ``least`` words or more
        kept.groupBy("tie", "tie2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("n_words").alias("n_words")), "texts"
    )
    differ = (F.col("a") != F.col("b")) | (F.col("c") != F.col("d"))
    often = kept.groupBy("h").agg(F.min("tie").alias("a"), F.max("tie").alias("b"), F.min("tie2").alias("c"), F.max("tie2").alias("d"))
    often = written(often.where(differ).select("h"), "often")
    # nothing stands above the joins but the writes, so Spark can split a hash or a text that very many share
    shared = written(kept.join(often, "h", "left_semi").select("doc_id", "tie", "tie2", "place", "h"), "shared")
    own = written(shared.join(texts, ["tie", "tie2"]).where("doc_id = low").select("doc_id", "tie", "tie2", (F.col("low") < F.col("high")).alias("whole"), "place", "h"), "own")
    by_text = own.groupBy("doc_id", "tie", "tie2", "whole").agg(F.collect_set(F.struct("place", "h")).alias("at"))
    owner = F.when(F.col("whole"), F.xxhash64("tie", "tie2")).otherwise(F.xxhash64("doc_id")).alias("owner")
    found = rows.join(by_text, ["doc_id", "tie", "tie2"]).select("doc_id", "tie", "text", "at.place", "at.h", "whole", owner)
    suffixes = written(found.mapInArrow(contexts, _ROW), "suffixes")
    matches, reach_right = _sorted_matches(suffixes, True, least, gram)
    more, reach_left = _sorted_matches(suffixes, False, least, gram)
    matches = matches.unionByName(more)
    doubt = written(_doubtful(reach_right, reach_left, size), "in_doubt")
    if doubt.limit(1).count():
        matches = matches.unionByName(_matches_in_doubt(suffixes, doubt, least, gram))
    placed = matches.repartition("doc_id").sortWithinPartitions("doc_id", "tie", "start")
    spans = placed.mapInArrow(_join_spans, "doc_id long, start_word int, end_word int, n_words int, other_doc_id long")
    copies = written(kept.select("doc_id", "tie", "tie2").distinct().join(texts.where("low < high"), ["tie", "tie2"]), "copies")
    whole = copies.select(
        "doc_id", F.lit(0).alias("start_word"), F.col("n_words").alias("end_word"), "n_words",
        F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other_doc_id"),
    )
    return spans.unionByName(whole)
