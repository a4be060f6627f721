"""Best-fit packing of token sequences by minimum bin slack.

1. Executors encode the texts and write one row a piece: only longer documents are cut, into
   ``capacity`` tokens each. A piece gets its rank among the pieces of its length in its task.
2. What the packer needs is how many pieces there are of each length: ``capacity`` numbers at
   most, whatever the corpus holds. For each bin it takes the longest piece left and, by a bitset
   subset-sum over the lengths left, the fullest combination that fits with it; this is removed as
   often as the counts allow. Each such pattern uses up at least one length's pieces.
3. A piece's rank among all of its length gives its pattern, sequence and offset by binary search
   in a table that is bounded like the patterns, so pieces are placed without being gathered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import TEXT_ROWS, release, written
from tidemark.llm.encoding import chunks, encoder

END_ID, CAPACITY = 1, 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, from those in ``counts``, whose sum is the largest not over ``room``.

    Bit s of a bitset says that s can be made. Longer lengths come first and the search ends as
    soon as the room can be filled, so short pieces are kept for later bins.
    """
    limit, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= reach << (length * part) & limit
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in one bin, number of such bins) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        one = fullest(rest, capacity - longest)
        one[longest] = one.get(longest, 0) + 1
        times = min(left[k] // n for k, n in one.items())
        out.append((one, times))
        for k, n in one.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For ranges of ranks of a length: the first sequence, pieces a bin, and offset in the bin."""
    rows, taken, sequence = [], {}, 0
    for one, times in found:
        offset = 0
        for length in sorted(one, reverse=True):
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, one[length], offset))
            taken[length] = rank + one[length] * times
            offset += length * one[length]
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), cols))


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece, as written in the shared folder; with ``keep_ids`` its ids as uint32 bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ranks, enc = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 3_000_000):
                ids, counts = enc.encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, "<u4")
                own = np.ones(len(out), bool)
                own[ends - 1] = False
                out[own] = ids
                n = -(-(counts + 1) // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[doc] + 1 - start, capacity)
                at = (ends - counts - 1)[doc] + start
                raw = memoryview(out.view(np.uint8))
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                by = length[order]
                first = np.concatenate(([0], np.flatnonzero(np.diff(by)) + 1))
                sizes = np.diff(np.concatenate((first, [len(by)])))
                nth = np.empty(len(by), np.int64)
                nth[order] = ranks[by] + np.arange(len(by)) - np.repeat(first, sizes)
                ranks[by[first]] += sizes
                cols = [
                    doc_ids.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth),
                ]
                if keep_ids:
                    cols.append(pa.array([bytes(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)
            release()

    schema = _PIECES + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(cut, schema), "pieces", TEXT_ROWS)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece.

    A null or empty text is one piece with the end id alone. Repeated rows, and rows without
    doc_id, are packed each on their own. Other columns are ignored, whatever their names. An empty
    table gives an empty result. Sequences are gapless from offset 0 and hold ``capacity`` at most.
    """
    spark = documents.sparkSession
    cut = pieces(documents, tokenizer, capacity, end_id, keep_ids)
    by_task = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    table = spark.sparkContext.broadcast(places(patterns(counts, capacity)))

    kind = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType())])

    @F.pandas_udf(kind)
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = table.value
        key = np.int64(1) << np.int64(40)  # ranks of a length stay far below
        x, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        k = np.searchsorted(t["length"] * key + t["rank"], x * key + r, side="right") - 1
        bin_, slot = np.divmod(r - t["rank"][k], t["each"][k])
        return pd.DataFrame({"sequence_id": t["sequence"][k] + bin_, "offset": t["offset"][k] + slot * x})

    before = by_task.withColumn(
        "base", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ).select("length", "task", "base")
    placed = cut.join(written(before, "bases"), ["length", "task"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))
