"""Token ids of a corpus in shards, each one wavelet matrix in one compressed file.

A wavelet matrix holds a sequence as one bit plane for each bit of its ids, most significant
first; before each next plane the sequence is parted stably by the bit. Planes are kept in blocks,
each compressed by itself, with the number of ones before each block, so a token can be reached,
counted or found by reading a block a plane.

File: magic, length of the header, the header as JSON (sizes, zeros of each plane, places of the
blocks and sections), then the sections: ones before each block, doc ids, their validity, their
numbers of tokens, blocks.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written
from tidemark.llm.encoding import chunks, encoder
from tidemark.llm.storage import read_bytes, write_bytes

MAGIC, BLOCK_BYTES, GROUP = b"TMWAVE1\n", 1 << 14, 64
END_ID, ID_BITS, SHARD_TOKENS = 2, 16, 4_000_000


def encode_shard(ids: np.ndarray, bits: int, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """The file's bytes for ``ids``, which are the documents' ids one after another."""
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    zeros, blocks, sizes, before = [], [], [], []
    for plane in range(bits - 1, -1, -1):
        ones = (seq & seq.dtype.type(1 << plane)) != 0
        packed = np.packbits(ones, bitorder="little")
        per = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK_BYTES), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        before.append(np.cumsum(per) - per)
        zeros.append(len(seq) - int(per.sum()))
        raw = packed.tobytes()
        own = [pack.compress(raw[k : k + BLOCK_BYTES]) for k in range(0, len(raw), BLOCK_BYTES)]
        blocks += own
        sizes.append([len(x) for x in own])
        if plane:
            seq = np.concatenate((seq[np.flatnonzero(~ones)], seq[np.flatnonzero(ones)]))  # places gather faster than flags
    valid = np.array([x is not None for x in doc_ids], bool)
    parts = [
        pack.compress(np.array(before, "<i8").tobytes()), pack.compress(np.array([x or 0 for x in doc_ids], "<i8").tobytes()),
        pack.compress(np.packbits(valid).tobytes()), pack.compress(counts.astype("<i8").tobytes()),
    ]
    head = json.dumps({
        "tokens": len(ids), "bits": bits, "documents": len(doc_ids), "block_bytes": BLOCK_BYTES, "zeros": zeros,
        "sections": [len(x) for x in parts], "blocks": sizes,
    }).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *parts, *blocks])


class WaveletShard:
    """One shard read back: tokens by place, counts and places of an id, or all ids in order."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack("<Q", data[8:16])[0]
        head = json.loads(data[16 : 16 + size])
        self.tokens, self.bits, self.documents = head["tokens"], head["bits"], head["documents"]
        self._data, self._zeros, self._block = data, head["zeros"], head["block_bytes"]
        self._open, at, parts = zstandard.ZstdDecompressor(), 16 + size, []
        for n in head["sections"]:
            parts.append(self._open.decompress(data[at : at + n]))
            at += n
        self._before = np.frombuffer(parts[0], "<i8").reshape(self.bits, -1)
        valid = np.unpackbits(np.frombuffer(parts[2], np.uint8), count=self.documents).astype(bool)
        self.doc_ids = [x if v else None for x, v in zip(np.frombuffer(parts[1], "<i8").tolist(), valid)]
        self.counts = np.frombuffer(parts[3], "<i8")
        self._places = []
        for sizes in head["blocks"]:
            ends = at + np.cumsum([0, *sizes])
            self._places.append(ends)
            at = int(ends[-1])
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _bytes(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones before each GROUP of them: the directory within the block."""
        if (plane, block) not in self._kept:
            if len(self._kept) >= 256:
                self._kept.clear()
            a, b = self._places[plane][block : block + 2]
            raw = np.frombuffer(self._open.decompress(self._data[a:b]), np.uint8)
            per = np.add.reduceat(np.bitwise_count(raw), np.arange(0, len(raw), GROUP), dtype=np.int64)
            self._kept[plane, block] = raw, np.cumsum(per) - per
        return self._kept[plane, block]

    def _ones(self, plane: int, place: int) -> int:
        """Ones of the plane before ``place``."""
        block, rest = divmod(place, 8 * self._block)
        if block >= self._before.shape[1]:
            return self.tokens - self._zeros[plane]
        raw, before = self._bytes(plane, block)
        group = min(rest // 8 // GROUP, len(before) - 1)
        n = int(self._before[plane, block]) + int(before[group]) + int(np.bitwise_count(raw[group * GROUP : rest // 8]).sum())
        return n + (int(raw[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else n

    def access(self, place: int) -> int:
        """The id at ``place``."""
        if not 0 <= place < self.tokens:
            raise IndexError(place)
        out = 0
        for p in range(self.bits):
            block, rest = divmod(place, 8 * self._block)
            bit = int(self._bytes(p, block)[0][rest // 8]) >> rest % 8 & 1
            ones = self._ones(p, place)
            out, place = out << 1 | bit, self._zeros[p] + ones if bit else place - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` before ``end`` lie below the last plane."""
        a, b = 0, end
        for p in range(self.bits):
            x, y = self._ones(p, a), self._ones(p, b)
            a, b = (self._zeros[p] + x, self._zeros[p] + y) if token >> (self.bits - 1 - p) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before ``end`` (all by default)."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, self.tokens if end is None else end)
        return b - a

    def _find(self, plane: int, bit: int, nth: int) -> int:
        """Place of the nth zero or one of a plane."""
        starts = self._before[plane] if bit else np.arange(self._before.shape[1]) * 8 * self._block - self._before[plane]
        block = int(np.searchsorted(starts, nth, side="right")) - 1
        raw, before = self._bytes(plane, block)
        nth, own = nth - int(starts[block]), before if bit else np.arange(len(before)) * 8 * GROUP - before
        group = int(np.searchsorted(own, nth, side="right")) - 1
        flags = np.unpackbits(raw[group * GROUP : (group + 1) * GROUP], bitorder="little")
        return 8 * (block * self._block + group * GROUP) + int(np.flatnonzero(flags == bit)[nth - int(own[group])])

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of ``token``."""
        if not 0 <= nth < self.rank(token):
            raise IndexError(nth)
        place = self._range(token, self.tokens)[0] + nth
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            place = self._find(p, bit, place - self._zeros[p] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.tokens, kind)
        for p in range(self.bits - 1, -1, -1):
            places = self._places[p]
            raw = b"".join(self._open.decompress(self._data[a:b]) for a, b in zip(places[:-1], places[1:]))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.tokens, bitorder="little").astype(bool)
            above = np.empty_like(seq)
            above[np.flatnonzero(~ones)] = seq[: self._zeros[p]]
            above[np.flatnonzero(ones)] = seq[self._zeros[p] :] | kind(1 << (self.bits - 1 - p))
            seq = above
        return seq


def write_shards(
    documents: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, bits: int = ID_BITS, shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode ``documents`` (doc_id, text) and write shards in ascending doc_id order to ``folder``.

    Gives the manifest (shard, path, documents, tokens); shard numbers follow the documents' order.
    A document is never parted, so a shard holds about ``shard_tokens`` ids. Null texts are empty,
    documents without doc_id come first, equal doc_ids in the order of a hash of their texts.
    An empty table gives an empty manifest.
    """
    folder = (folder or scratch(documents.sparkSession, "shards")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc, part = TaskContext.get().partitionId(), encoder(tokenizer), 0
        own: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal own, sizes, names, held, part
            counts = np.concatenate(sizes)
            path = f"{folder}/{task:06d}-{part:04d}-{uuid.uuid4().hex}.wave"
            write_bytes(path, encode_shard(np.concatenate(own), bits, names, counts))
            row = pa.RecordBatch.from_pylist([{"shard": (task << 20) + part, "path": path, "documents": len(names), "tokens": held}], schema)
            own, sizes, names, held, part = [], [], [], 0, part + 1
            return row

        schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, counts = enc.encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, np.uint32)
                at = np.ones(len(out), bool)
                at[ends - 1] = False
                out[at] = ids
                if bits < 32 and out.max() >> bits:
                    raise ValueError(f"an id needs more than {bits} bits")
                done = 0
                while done < b - a:  # as many whole documents as the shard takes, one at least if it is empty
                    base = int(ends[done - 1]) if done else 0
                    to = max(int(np.searchsorted(ends, base + shard_tokens - held, side="right")), done + (not names))
                    if to == done:
                        yield close()
                        continue
                    own.append(out[base : int(ends[to - 1])].astype(np.uint16 if bits <= 16 else np.uint32))
                    sizes.append(counts[done:to] + 1)
                    names += doc_ids[a + done : a + to]
                    held, done = held + int(ends[to - 1]) - base, to
                    if held >= shard_tokens:
                        yield close()
        if names:
            yield close()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return written(placed.select("doc_id", "text").mapInArrow(write, "shard long, path string, documents long, tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletShard(read_bytes(path))
                ids = shard.ids()
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc, step = [], max(1, len(starts) // max(1, -(-shard.tokens // 1_000_000)))
                for k in range(0, len(starts), step):
                    a, b = int(starts[k]), int(ends[min(k + step, len(ends)) - 1])
                    raw = memoryview(ids[a:b].astype("<u4").view(np.uint8))
                    crc += [zlib.crc32(raw[4 * (x - a) : 4 * (y - a)]) for x, y in zip(starts[k : k + step].tolist(), ends[k : k + step].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base), pa.array(shard.counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row a shard of millions of ids: a running sum over a small table
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks).select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
