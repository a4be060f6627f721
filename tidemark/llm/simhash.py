"""SimHash near-duplicate groups by a Gray-order hierarchical index.

1. Fingerprints: 64-bit majority of XXH64 (seed 42) over 3-word shingles, in Arrow batches.
2. Equal fingerprints fold into one row first, so thousands of copies cost one row after that.
3. Index: 64 bits are cut in 5 blocks. Two fingerprints that differ in at most 2 bits agree on 3
   whole blocks, so each of the 10 choices of 3 blocks gives top nodes (a mask and the pattern its
   members share) and every link lies inside at least one top node.
4. Within a top node members are sorted by Gray rank. Leaves are runs of that order, upper nodes
   join leaves; each node keeps the bits all its members share. Pairs of nodes are descended
   together, and a pair goes as a whole once the shared bits differ more than the limit.
5. Each top node gives a spanning set of its links (at most one a member), not all its pairs.
   Top nodes with more than ``split`` members are cut once more by 3 parts of the free bits, one of
   which must agree; a node then has at most 2**18 members, whatever the corpus holds.
6. Components come from iterated hooking over the links (components.py).

``keep_one`` (the pipeline's stage) also joins groups by the exact Jaccard similarity of 5-word
shingles: at 0.8 fingerprints of 64 bits differ in about ten, too many for any index of shared
bits. Its candidates share one of 24 keys of five least hashes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import TEXT_ROWS, Scratch, among, release, with_mark, written
from tidemark.llm.components import connected_components
from tidemark.llm.encoding import chunks
from tidemark.llm.suffixes import word_hashes

WIDTHS = (13, 13, 13, 13, 12)
LEAF, FAN = 32, 8
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one whole text; 0 where there is no word."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        at = np.concatenate(([0], np.cumsum(lens)))
        ends = (at[shingle:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(at.tolist(), ends)), np.uint64, len(ends))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    out = pd.Series(np.fromiter(map(fingerprint, text), np.uint64, len(text)).view(np.int64))
    release()
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray order (inverse Gray code)."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared mask, shared pattern) of the nodes of each level, leaves first, a root last."""
    starts = np.arange(0, len(fps), LEAF)
    first = fps[starts]
    mask = ~(np.bitwise_or.reduceat(fps, starts) ^ np.bitwise_and.reduceat(fps, starts))
    out = [(mask, first & mask)]
    while len(mask) > 1:
        s = np.arange(0, len(mask), FAN)
        m, p = out[-1]
        all_shared = np.bitwise_and.reduceat(m, s)
        low, high = np.bitwise_and.reduceat(p, s), np.bitwise_or.reduceat(p, s)
        mask = all_shared & ~(low ^ high)
        out.append((mask, p[s] & mask))
    return out


def node_links(fps: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of the members of one top node that differ in at most ``limit`` bits.

    ``fps`` is sorted by Gray rank. Pairs come in bounded blocks, never all at once.
    """
    levels = _levels(fps)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        k, u, v = todo.pop()
        mask, pattern = levels[k]
        apart = np.bitwise_count((pattern[u] ^ pattern[v]) & mask[u] & mask[v])
        u, v = u[apart <= limit], v[apart <= limit]
        if not len(u):
            continue
        size, below = (LEAF, len(fps)) if k == 0 else (FAN, len(levels[k - 1][0]))
        step = max(1, (1 << 20) // (size * size))
        for c in range(0, len(u), step):
            left = (u[c : c + step, None] * size + np.arange(size))[:, :, None]
            right = (v[c : c + step, None] * size + np.arange(size))[:, None, :]
            ok = (left < below) & (right < below) & ((left < right) if k == 0 else (left <= right))
            i, j = (x[ok] for x in np.broadcast_arrays(left, right))
            if k:
                todo.append((k - 1, i, j))
            else:
                near = np.bitwise_count(fps[i] ^ fps[j]) <= limit
                yield i[near], j[near]


def spanning_links(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of one top node join: (member, smallest index of its class)."""
    label = np.arange(len(fps))
    for i, j in node_links(fps[order := np.argsort(gray_rank(fps), kind="stable")], limit):
        i, j = order[i], order[j]
        while len(i):
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    own = np.flatnonzero(label != np.arange(len(fps)))
    return own, label[own]


def _search(limit: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def links(kind, pattern, fp):
            cut = np.flatnonzero((np.diff(kind) != 0) | (np.diff(pattern) != 0)) + 1
            starts = np.concatenate(([0], cut))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            some_a, some_b = [], []
            u = fp.view(np.uint64)
            pairs = starts[sizes == 2]  # most nodes that are not alone
            near = pairs[np.bitwise_count(u[pairs] ^ u[pairs + 1]) <= limit]
            some_a.append(fp[near + 1])
            some_b.append(fp[near])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                i, j = spanning_links(u[s : s + n], limit)
                some_a.append(fp[s + i])
                some_b.append(fp[s + j])
            a, b = np.concatenate(some_a), np.concatenate(some_b)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:  # sorted by node, so only the last node of a batch may go on
            got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            kind, pattern, fp = (np.concatenate((x, y)) for x, y in zip(rest, got))
            if not len(fp):
                continue
            inner = np.flatnonzero((kind != kind[-1]) | (pattern != pattern[-1]))
            end = inner[-1] + 1 if len(inner) else 0
            rest = (kind[end:], pattern[end:], fp[end:])
            if end:
                yield links(kind[:end], pattern[:end], fp[:end])
        if len(rest[2]):
            yield links(*rest)

    return over


def _masks() -> list[tuple[int, list[int]]]:
    """For each choice of 3 blocks: its mask, and 3 masks that part the free bits."""
    at, blocks = 0, []
    for w in WIDTHS:
        blocks.append(((1 << w) - 1) << at)
        at += w
    out = []
    for chosen in combinations(range(len(WIDTHS)), 3):
        mask = sum(blocks[k] for k in chosen)
        free = [k for k in range(64) if not mask >> k & 1]
        third = -(-len(free) // 3)
        out.append((mask, [sum(1 << k for k in free[i : i + third]) for i in range(0, len(free), third)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(fps: DataFrame, limit: int = 2, split: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at ``limit`` (2 at most) or fewer bits.

    The links join exactly what all the pairs would join. ``split`` only sets from what size on a
    top node is cut once more; no node, candidate or link is left out.
    """
    if not 0 <= limit <= 2:
        raise ValueError("the block layout holds for limits 0 to 2")
    masks = _masks()
    nodes = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("pattern"))
        for k, (m, _) in enumerate(masks)
    ])
    keyed = fps.select(F.explode(nodes).alias("n"), "fp").select("n.kind", "n.pattern", "fp")
    large = written(keyed.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > split), "large")
    if large.limit(1).count():
        marked = keyed.join(large, ["kind", "pattern"], "left")
        parts = F.create_map(*[
            x for k, (m, subs) in enumerate(masks)
            for x in (F.lit(k), F.array(*[F.lit(_signed(m | s)) for s in subs]))
        ])
        finer = marked.where("n is not null").select(
            (F.col("kind") * 4).alias("kind0"), F.posexplode(parts[F.col("kind")]).alias("sub", "mask"), "fp"
        ).select(
            (F.col("kind0") + F.col("sub") + 100).cast("int").alias("kind"), F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp"
        )
        keyed = marked.where("n is null").select("kind", "pattern", "fp").unionByName(finer)
    placed = keyed.repartition("kind", "pattern").sortWithinPartitions("kind", "pattern", "fp")
    return placed.mapInArrow(_search(limit), "a long, b long")


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(documents: DataFrame, limit: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``documents``.

    A null or blank text has fingerprint zero and links like any other. Repeated rows come back as
    often as they came. A row without doc_id has a fingerprint but no component and links nothing.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    marked = written(documents.select("doc_id", fingerprint_udf("text").alias("fp")), "fingerprints", TEXT_ROWS)
    fps = written(
        marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct"
    )
    groups = connected_components(written(fingerprint_links(fps.select("fp"), limit), "links"))
    linked = fps.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(linked.join(lows, "root").select("fp", "component_id"), "components")
    return marked.join(named, "fp", "left").select(
        "doc_id", fp_hex(F.col("fp")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


BANDS, ROWS, SHINGLE, SIMILAR, BUCKET_BITS = 24, 5, 5, 0.8, 20
_MIX = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of texts, and each text's range; a shorter text is one shingle."""
    words, edges = word_hashes(texts)
    n = np.diff(edges)
    size = np.minimum(n, SHINGLE)
    counts = n - size + (n > 0)
    starts = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(starts[-1]) + np.repeat(edges[:-1] - starts[:-1], counts)
    size, h = np.repeat(size, counts), np.zeros(starts[-1], np.uint64)
    for k in range(SHINGLE):
        more = k < size
        h[more] = (h[more] ^ words[at[more] + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, starts


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, keys): texts of Jaccard similarity s share a key but for a chance of (1 - s**ROWS)**BANDS."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts, 1_000_000):
            h, starts = _shingles(texts[a:b])
            own = np.flatnonzero(np.diff(starts))
            if not len(own):
                continue
            keys = np.zeros((len(own), BANDS), np.uint64)
            for k in range(BANDS * ROWS):
                low = np.minimum.reduceat(h * _MIX[k], starts[own])
                j = k // ROWS
                keys[:, j] = (keys[:, j] + low + np.uint64(j)) * np.uint64(0xC2B2AE3D27D4EB4F)
                keys[:, j] ^= keys[:, j] >> np.uint64(31)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(own + a)), flat], names=["doc_id", "keys"])
        release()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, the text's distinct shingles in order as 8 bytes each)."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts, 1_000_000):
            h, starts = _shingles(texts[a:b])
            sets = [np.unique(h[x:y]).tobytes() for x, y in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])
        release()


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _rarest(texts: DataFrame, tmp: Scratch) -> DataFrame:
    """(shingle, doc_id, root, n, place): of each text as many of its rarest shingles as two similar texts must share one of.

    The order is by how often a shingle's bucket occurs, then by the shingle; the counts are 2**BUCKET_BITS numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(n, _bucket(np.frombuffer(x.as_buffer(), np.uint64)), 1)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[k])], names=["bucket", "n"])

    counted = tmp.written(texts.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "buckets", TEXT_ROWS)
    table = np.zeros(1 << BUCKET_BITS, np.int64)
    got = counted.toArrow()  # 2**BUCKET_BITS rows at most, whatever the corpus holds
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(3):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                order = np.lexsort((own, sent.value[_bucket(own)]))
                found.append(own[order[: len(own) - int(np.ceil(SIMILAR * len(own) - 1e-9)) + 1]])
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            at = np.concatenate([np.arange(len(x)) for x in found]) if found else np.zeros(0, np.int64)
            cols = [pa.array(flat.view(np.int64)), *[batch.column(k).take(rows) for k in range(3)], pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["shingle", "doc_id", "root", "n", "place"])
            release()

    return texts.mapInArrow(pick, "shingle long, doc_id long, root long, n int, place int")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, shingles of a, shingles of b) whose Jaccard similarity is SIMILAR or more."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
            if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both >= SIMILAR * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))
        release()


def similar_groups(documents: DataFrame, limit: int = 2) -> DataFrame:
    """(doc_id, root): the groups of near_duplicates, joined where two texts have Jaccard similarity SIMILAR.

    ``documents`` has one row for each doc_id. Candidates are texts of different groups that share
    one of BANDS keys, each of ROWS least hashes, and whose numbers of shingles allow the similarity; a link
    counts only by its exact similarity. In a round each text is compared with one hub: the smallest id it
    shares a key with and was not compared with yet. Rounds go on as long as they join groups. A last one takes
    the texts whose keys lead to different groups still: of two similar ones the rarest fifth of the shingles, in one
    order for all, have one in common, with enough behind it; other pairs are passed over without loss.
    """
    tmp = Scratch(documents.sparkSession)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = near_duplicates(documents, limit).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("component_id").cast("long").alias("root"))
    groups = tmp.written(groups, "groups")
    banded = texts.mapInArrow(_band_keys, "doc_id long, keys array<long>").join(groups, "doc_id")
    # copies of one text have the same keys: the smallest id of each group stands for them
    folded = banded.groupBy("root", "keys").agg(F.min("doc_id").alias("doc_id"))
    keyed = tmp.written(folded.select("doc_id", "root", F.explode("keys").alias("key")), "keys", TEXT_ROWS)

    def live(keyed: DataFrame) -> DataFrame:
        """Keys whose members are in different groups, with their smallest member."""
        ends = keyed.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.min(F.struct("doc_id", "root", "n")).alias("hub"))
        return tmp.written(ends.where("first <> last").select("key", "hub"), "live")

    ends = keyed.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"))
    shared = tmp.written(ends.where("first <> last").select("key"), "live")
    members = tmp.written(among(keyed, "key", shared).join(shared, "key", "left_semi").select("key", "doc_id"), "members")
    tmp.remove("keys", "live")
    known = tmp.written(members.select("doc_id").distinct(), "known")
    sets = tmp.written(among(texts, "doc_id", known).join(known, "doc_id").select("doc_id", "text").mapInArrow(_shingle_sets, "doc_id long, shingles binary"), "sets", TEXT_ROWS)
    own = groups.join(sets.select("doc_id", (F.length("shingles") / 8).cast("int").alias("n")), "doc_id").select("doc_id", "root", "n")
    own, tested, lower, hubs = tmp.written(own, "own"), None, None, True
    tmp.remove("known")
    named = lambda x, pairs: among(sets, "doc_id", pairs.select(x)).select(F.col("doc_id").alias(x), F.col("shingles").alias(f"{x}_set"))
    rooted = lambda x: own.select(F.col("doc_id").alias(x), F.col("root").alias(f"{x}_root"))
    alike = lambda m, n: F.least(m, n) >= SIMILAR * F.greatest(m, n)
    while True:
        keyed = members.join(own, "doc_id").select("key", "doc_id", "root", "n")
        ends = live(keyed)
        if hubs:
            each = keyed.join(ends, "key").where((F.col("hub.root") != F.col("root")) & alike(F.col("n"), F.col("hub.n")))
            pairs = each.select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        else:
            left_over = tmp.written(keyed.join(ends, "key", "left_semi").select("doc_id", "root", "n").distinct(), "left_over")
            rare = tmp.written(_rarest(left_over.join(among(sets, "doc_id", left_over.select("doc_id")), "doc_id").select("doc_id", "root", "n", "shingles"), tmp), "rare", TEXT_ROWS)
            side = lambda x: rare.select(*[F.col(c).alias(f"{x}_{c}") for c in ("shingle", "doc_id", "root", "n", "place")])
            apart = (F.col("a_root") != F.col("b_root")) & (F.col("a_doc_id") < F.col("b_doc_id")) & alike(F.col("a_n"), F.col("b_n"))
            # from the first shingle they share on, enough must be left on both sides
            left = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
            enough = left * (1 + SIMILAR) >= (F.col("a_n") + F.col("b_n")) * SIMILAR - 1e-6
            pairs = side("a").join(side("b"), (F.col("a_shingle") == F.col("b_shingle")) & apart & enough).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if hubs:
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        pairs = tmp.written(pairs, "pairs")
        near = tmp.written(pairs.join(named("a", pairs), "a").join(named("b", pairs), "b").select("a", "b", "a_set", "b_set").mapInArrow(_similar, "a long, b long"), "near", TEXT_ROWS)
        edges = tmp.written(near.join(rooted("a"), "a").join(rooted("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        joins = edges.limit(1).count() > 0
        if joins:
            moved = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
            to = F.coalesce("to", "root").alias("root")
            own = tmp.written(own.join(moved, "root", "left").select("doc_id", to, "n"), "own")
            if lower is None:
                lower = moved.select(F.col("root").alias("group"), F.col("to").alias("root"))
            else:  # groups that moved before move on; others move now
                again = lower.join(moved, "root", "left").select("group", to)
                fresh = moved.join(lower.select(F.col("group").alias("root")), "root", "left_anti").select(F.col("root").alias("group"), F.col("to").alias("root"))
                lower = again.unionByName(fresh)
            lower = tmp.written(lower, "lower")
        tmp.remove("live", "near", "edges")
        if not hubs:
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        hubs = joins
    out = groups if lower is None else groups.withColumnRenamed("root", "group").join(lower, "group", "left").select("doc_id", F.coalesce("root", "group").alias("root"))
    out = written(out, "similar")
    tmp.remove()
    return out


def keep_one(documents: DataFrame, limit: int = 2) -> DataFrame:
    """The rows of ``documents`` that stay: of each group the one with the smallest doc_id.

    Groups are those of similar_groups. Of rows that repeat one doc_id the one whose text has the
    smallest hash stays, before groups are formed; rows without doc_id all stay. All columns of
    ``documents`` come back, and no others.
    """
    again = written(documents.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"), "again")
    single = documents
    if again.limit(1).count():
        tie = F.xxhash64("text")
        twice = documents.join(again, "doc_id", "left_semi").select(*documents.columns)
        best = twice.groupBy(F.col("doc_id").alias("own_id")).agg(F.min(tie).alias("own_tie"))
        chosen = twice.join(best, (F.col("doc_id") == F.col("own_id")) & (tie == F.col("own_tie"))).select(*documents.columns).dropDuplicates(["doc_id"])
        single = written(documents.join(again, "doc_id", "left_anti").select(*documents.columns).unionByName(chosen), "single")
    gone = similar_groups(single, limit).where("doc_id <> root").select("doc_id")
    marked = with_mark(single, "doc_id", gone)  # texts that stay for sure are not moved
    doubtful = marked.where("__in").join(gone, "doc_id", "left_anti")
    return marked.where("not __in").select(*documents.columns).unionByName(doubtful.select(*documents.columns))
