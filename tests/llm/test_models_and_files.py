"""Classifiers, packing, wavelet shards and archives: accuracy, brute force and exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import awkward, empty, labels, words
from tidemark.llm import packing, quality_classifier, toxicity, warc, wavelet
from tidemark.llm.common import held_out
from tidemark.llm.encoding import Encoder, chunks
from tidemark.llm.queries import tokenizer_path

TEXT = "doc_id long, text string"
BYTE, WORD = (tokenizer_path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
TRICKY = [
    "", " ", "\n", "a\n b", "  x", "x  ", "a \nb", "a  b", "a   b", " \n x \ny\n z", "a\n\nb c", "it's 's 're X'LL", "<|endoftext|> x", "don't 12 3\t\t4", "Ünïcode ½ Σίσυφος İx é",
    "a\x1cb", "日本語 text", "THE!! ÉTÉ!! 100%%% a|b", words(1, 500),
]


def plain_ids(path, texts, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(x.ids + [end], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_gives_the_librarys_ids(path):
    e = Encoder(path, units=50)
    for texts in (TRICKY, TRICKY[:1], [], [x for x in TRICKY if x.isascii()] * 2):
        ids, counts = e.encode(texts)
        want = [x[:-1].tolist() for x in plain_ids(path, texts, 0)] if texts else []
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abé A'sT.!%1 \n\t"), max_size=40))
def test_encoder_on_random_texts(text):
    for path in (BYTE, WORD):
        assert Encoder(path).encode([text, "x"])[0].tolist() == sum((x[:-1].tolist() for x in plain_ids(path, [text, "x"], 0)), [])


def test_chunks_cover_everything():
    assert chunks(["a" * 5, None, "b" * 30, "", "c"], 10) == [(0, 3), (3, 5)] and chunks([]) == []


# -- packing ---------------------------------------------------------------


def test_fullest_against_all_subsets():
    r = random.Random(4)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(0, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room) and all(n <= counts[k] for k, n in used.items())


def test_patterns_use_every_piece_once():
    r = random.Random(5)
    counts = {r.randint(1, 64): r.randint(1, 50) for _ in range(30)}
    found = packing.patterns(counts, 64)
    for length, n in counts.items():
        assert sum(one.get(length, 0) * times for one, times in found) == n
    assert all(sum(k * n for k, n in one.items()) <= 64 for one, _ in found)
    assert sum(t for _, t in found) <= first_fit([k for k, n in counts.items() for _ in range(n)], 64)


def first_fit(lengths, capacity):
    """Bins that first-fit decreasing takes."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= x), None)
        if k is None:
            rooms.append(capacity - x)
        else:
            rooms[k] -= x
    return len(rooms)


def check_packing(got, ids, capacity):
    for r in got.itertuples():
        own = ids[int(r.doc_id)][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == r.piece * capacity
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= capacity


def test_packing_round_trip(spark):
    texts = [words(k, 1 + k * k % 400) for k in range(120)] + ["", words(500, 1500)]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), TEXT).repartition(5), WORD, capacity=256, keep_ids=True).toPandas()
    ids = dict(enumerate(plain_ids(WORD, texts, 1)))
    check_packing(got, ids, 256)
    assert got.length.sum() == sum(map(len, ids.values())) and got.sequence_id.nunique() <= first_fit(got.length.tolist(), 256)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist() for r in got.itertuples())


def test_packing_of_awkward_rows(spark):
    got = packing.pack(awkward(spark), WORD).toPandas()
    assert got[got.piece == 0].shape[0] == awkward(spark).count() and got[got.doc_id == 0].length.tolist() == [1]
    assert packing.pack(empty(spark), WORD).count() == 0


# -- wavelet matrix --------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=0, max_size=400))
def test_wavelet_shard_answers(values):
    ids = np.array(values, np.uint32)
    shard = wavelet.WaveletShard(wavelet.encode_shard(ids, 9, [1], np.array([len(ids)])))
    assert shard.ids().tolist() == values
    for k, v in list(enumerate(values))[::7]:
        assert shard.access(k) == v and shard.rank(v, k) == values[:k].count(v) and shard.rank(v) == values.count(v)
        assert shard.select(v, values[:k].count(v)) == k
    assert shard.rank(511) == 0
    with pytest.raises(IndexError):
        shard.access(len(values))


def test_wavelet_across_blocks():
    rng = np.random.default_rng(6)
    ids = (rng.zipf(1.3, 400_000) % 50_000).astype(np.uint32)
    shard = wavelet.WaveletShard(wavelet.encode_shard(ids, 16, [None, 2], np.array([1, len(ids) - 1])))
    assert (shard.ids() == ids).all() and shard.doc_ids == [None, 2]
    for k in rng.integers(0, len(ids), 20).tolist():
        v = int(ids[k])
        n = int((ids[:k] == v).sum())
        assert shard.access(k) == v and shard.rank(v, k) == n and shard.select(v, n) == k


def test_shards_round_trip(spark):
    texts = [words(k, k % 90) for k in range(200)]
    manifest = wavelet.write_shards(spark.createDataFrame(list(enumerate(texts)), TEXT).repartition(6), BYTE, shard_tokens=2000)
    got = wavelet.read_shards(manifest).toPandas().sort_values("doc_id")
    ids = plain_ids(BYTE, texts, 2)
    n = np.array([len(x) for x in ids])
    assert manifest.count() > 4 and got.n_tokens.tolist() == n.tolist() and got.start.tolist() == (np.cumsum(n) - n).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(x.tobytes()) for x in ids]


def test_shards_of_awkward_rows(spark):
    got = wavelet.read_shards(wavelet.write_shards(awkward(spark), BYTE)).toPandas()
    assert len(got) == awkward(spark).count() and got.sort_values("start").doc_id.dropna().is_monotonic_increasing
    assert wavelet.read_shards(wavelet.write_shards(empty(spark), BYTE)).count() == 0


# -- archives --------------------------------------------------------------


def test_records_round_trip_in_small_reads():
    raw = [warc.build(k, f"http://x/{k}\r\nbad: 1", bytes([k]) * k, __import__("hashlib").sha256(bytes([k]) * k).hexdigest(), 1 if k == 3 else None) for k in range(5)]
    got = list(warc.read_records(io.BytesIO(b"".join(raw)), size=7))
    assert [r.headers["X-Page-ID"] for r in got] == list("01234") and [r.http_length() for r in got] == [0, 1, 2, 3, 4]
    assert got[3].headers["WARC-Type"] == "revisit" and got[3].payload() == b"" and got[4].payload() == b"\x04" * 4
    assert "bad" not in got[0].headers


def test_broken_records_are_refused():
    good = warc.build(1, "u", b"x" * 50, __import__("hashlib").sha256(b"x" * 50).hexdigest(), None)
    plain = zlib.decompress(good, 31)
    pack = lambda b: zlib.compress(b, wbits=31)
    for bad in (good[:-9], good[:40] + b"\x00" * 8 + good[48:], pack(plain.replace(b"xxx", b"xxy", 1)), pack(plain[:-1]), pack(b"no header"), pack(plain.replace(b"Content-Length: 1", b"Content-Length: 2"))):
        with pytest.raises(warc.BrokenRecord):
            list(warc.read_records(io.BytesIO(bad)))


def test_archives_round_trip(spark):
    import hashlib

    big, small = "<p>" + "x" * 200, "s"
    rows = [(5, "u", big, 1), (3, "a\r\nb", big, 1), (9, None, big, 1), (1, "q", small, 1), (2, "q", small, 1), (4, "q", None, 1), (None, "z", big, 1), (3, "u", big, 1), (7, "ü", "é" * 60, 1), (8, "ü", "é" * 60, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(pages, archive_bytes=600)).collect()}
    first = {}
    for p, _, h, _ in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    want = set()
    for p, _, h, _ in rows:
        raw, of = (h or "").encode(), first.get(h)
        again = of is not None and of != p
        want.add((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", of if again else None))
    assert got == want
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# -- classifiers -----------------------------------------------------------


def labelled(n=1200):
    r = random.Random(8)
    out = []
    for k in range(n):
        text, good, toxic = words(k, r.randint(20, 200)), int(r.random() < 0.7), int(r.random() < 0.2)
        if toxic:
            parts = text.split()
            for _ in range(4):
                parts.insert(r.randrange(len(parts)), r.choice(["idiot", "scum", "moron"]))
            text = " ".join(parts)
        out.append((k, text if good else text.replace(" ", "$$$ "), good, toxic))
    return out


@pytest.mark.parametrize("module, column", [(quality_classifier, 2), (toxicity, 3)])
def test_held_out_accuracy(spark, module, column):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], TEXT)
    lab = labels(spark, [(r[0], r[2], r[3]) for r in rows])
    got = module.classify(docs, lab).toPandas()
    truth = {r[0]: r[column] for r in rows}
    out = got[got.held_out]
    assert 0.15 < len(out) / len(rows) < 0.35 and got.score.between(0, 1).all()
    assert (out.predicted == out.doc_id.map(truth)).mean() > 0.93


def test_held_out_labels_are_not_learned_from(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([r[:2] for r in rows], TEXT)
    lab = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int")
    flipped = lab.withColumn("q", held_out(lab.doc_id)).selectExpr("doc_id", "case when q then 1 - quality else quality end as quality", "case when q then 1 - toxic else toxic end as toxic")
    for m in (quality_classifier, toxicity):
        a, b = (m.classify(docs, x).toPandas().sort_values("doc_id").score.to_numpy() for x in (lab, flipped))
        assert np.array_equal(a, b)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_on_awkward_rows(spark, module):
    docs = awkward(spark)
    for lab in (labels(spark), labels(spark, [(4, 1, 1), (6, 0, 0), (9, 1, 0), (3, 0, 1)])):
        got = module.classify(docs, lab).toPandas()
        assert len(got) == docs.count() and got.score.between(0, 1).all() and not got.held_out.isna().any()
    assert module.classify(empty(spark), labels(spark)).count() == 0
