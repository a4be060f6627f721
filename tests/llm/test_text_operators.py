"""Suffix dedup, SimHash, quality rules, decontamination and personal data against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.cases import awkward, empty, labels, words
from tidemark.llm import components, decontamination, pii, quality_rules, simhash, suffixes

TEXT = "doc_id long, text string"


# -- suffix arrays ---------------------------------------------------------


def covered(docs, least=50):
    """For each id the set of places in a window of ``least`` words that another id has, too."""
    own = {i: (t or "").encode().lower().split() for i, t in docs}
    where = defaultdict(set)
    for i, w in own.items():
        for k in range(len(w) - least + 1):
            where[tuple(w[k : k + least])].add(i)
    return {
        i: {p for k in range(len(w) - least + 1) if len(where[tuple(w[k : k + least])]) > 1 for p in range(k, k + least)} for i, w in own.items()
    }


def test_repeated_passages_are_all_found(spark):
    shared, other = words(100, 70), words(101, 51)
    docs = [(k, words(k, 120)) for k in range(20)]
    docs += [(20 + k, f"{words(50 + k, 30)} {shared.upper()} {words(70 + k, 40)}") for k in range(15)]
    docs += [(40 + k, f"{words(150 + k, 9)} {other} {words(170 + k, 20)}") for k in range(3)]
    docs += [(50, words(7, 120)), (51, " ".join(["was"] * 300)), (52, " ".join(["was"] * 90)), (53, f"{words(200, 20)} {shared[: len(shared) // 2]}")]
    got = defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(docs, TEXT)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    want = {i: p for i, p in covered(docs).items() if p}
    assert dict(got) == want


@pytest.mark.parametrize(("lines", "size", "each"), [(100, 20, 20), (60, 10, 30), (40, 12, 25)])
def test_no_window_of_frequent_lines_is_missed(spark, lines, size, each):
    rng = np.random.default_rng(lines)
    known = [words(1000 + k, size) for k in range(lines)]
    docs = [(k, " ".join(known[x] for x in rng.integers(0, lines, each))) for k in range(300)]
    docs += [(300 + k, docs[k][1]) for k in range(30)] + [(5, docs[9][1]), (5, docs[9][1])]  # copies, and an id of two texts
    got = defaultdict(set)
    for r in suffixes.repeated_passages(spark.createDataFrame(docs, TEXT).repartition(7)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    got.pop(5)
    assert dict(got) == {i: p for i, p in covered(docs[:-2]).items() if p and i != 5}


def test_suffixes_of_awkward_rows(spark):
    got = {r.doc_id for r in suffixes.repeated_passages(awkward(spark)).collect()}
    assert got == {4, 5}  # two ids, one text; rows that repeat id and text count once
    assert suffixes.repeated_passages(empty(spark)).count() == 0


def test_minimisers_are_chosen_by_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 9999, 50).astype(np.uint32)
    for _ in range(30):
        sides = [np.concatenate((rng.integers(1, 9999, rng.integers(0, 60)), shared, rng.integers(1, 9999, rng.integers(0, 60)))).astype(np.uint32) for _ in range(2)]
        kept = []
        for s in sides:
            at = next(k for k in range(len(s)) if (s[k : k + 50] == shared).all())
            kept.append({p - at for p in suffixes.anchors(s)[0].tolist() if 0 <= p - at <= 37})
        assert kept[0] & kept[1]


# -- SimHash ---------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows, limit=2):
    fp = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    root = list(range(len(fp)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= limit:
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(fp):
        low[find(k)] = min(low.get(find(k), i), i)
    return {(i, f"{x:016x}", low[find(k)]) for k, (i, x) in enumerate(fp)}


def test_near_duplicates_against_all_pairs(spark):
    docs = [(k, words(k, 30 + k)) for k in range(40)] + [(100 + k, words(9, 400) + f" {words(k, 1)}") for k in range(40)] + [(200 + k, t) for k, t in enumerate(["", "a", "A", "a b", None])]
    got = {tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(docs, TEXT)).collect()}
    assert got == plain_groups(docs)


@pytest.mark.parametrize("split", [1, 4096])
def test_links_join_what_all_pairs_join(spark, split):
    rng = np.random.default_rng(split)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    noise = np.array([sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 4), replace=False)) for _ in range(400)], np.uint64)
    fps = np.unique(np.concatenate((rng.integers(0, 2**63, 200, dtype=np.uint64), base[rng.integers(0, 6, 400)] ^ noise)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.fingerprint_links(df, split=split)).collect()}
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= 2]:
            a, b = sorted((find(int(x.view(np.int64))), find(int(y.view(np.int64)))))
            root[b] = a
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}


def test_node_links_prune_without_loss():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 2**14, 3000, dtype=np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    got = {(int(a), int(b)) for i, j in simhash.node_links(fps, 2) for a, b in zip(i, j)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}


def test_simhash_of_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, 0, 3, 4, 6, 7, 8, 9]
    assert simhash.keep_one(empty(spark)).count() == 0 == simhash.near_duplicates(empty(spark)).count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(40)}


# -- quality rules ---------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(grams)
    twice = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(twice)


def test_counts_against_plain_ones(spark):
    texts = ["", None, " \x0b ", "a b", "x y z\nx y z\n\nx y z", "é ü 日本|#", words(1, 200) + "\n" + words(1, 200), " ".join(["w"] * 9), "\x1c a\x85b", words(5, 100)]
    got = quality_rules.score(spark.createDataFrame(list(enumerate(texts)), TEXT + "").selectExpr("*", "'en' as lang"), labels(spark)).collect()
    for r in got:
        assert tuple(r)[1:6] == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)


def test_certified_bounds_are_exact():
    from math import comb

    for n, k, risk, level in ((200, 0, 0.02, 0.05), (200, 1, 0.02, 0.05), (50, 3, 0.2, 0.05), (1000, 5, 0.01, 0.06), (1000, 4, 0.01, 0.06), (10, 0, 0.3, 0.03)):
        tail = sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1))
        assert quality_rules.certified(k, n, risk, level) == (tail <= level), (n, k)


def test_cutoffs_part_junk_and_bound_false_rejection(spark):
    good = [(k, words(k, 60), "en") for k in range(1500)]
    bad = [(5000 + k, words(k, 60).replace(" ", "*** "), "en") for k in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    lab = labels(spark, [(k, 1, 0) for k, _, _ in good] + [(k, 0, 0) for k, _, _ in bad])
    got = quality_rules.score(docs, lab).toPandas().set_index("doc_id").kept.sort_index()
    assert got.loc[:1499].mean() >= 0.97 and got.loc[5000:].sum() == 0
    few = quality_rules.score(docs, lab.where("doc_id % 20 = 0")).toPandas().set_index("doc_id")
    assert (few.kept == ~few.base_failed).all() and not few.certified.any()  # too few labels to certify anything


def test_each_of_many_languages_has_cutoffs_of_its_own(spark):
    docs = [(1000 * s + k, words(k, 30) if k < 400 else words(k, 30).replace(" ", "*** "), f"l{s}") for s in range(70) for k in range(0, 460)]
    featured = spark.createDataFrame(docs, "doc_id long, text string, lang string").select("doc_id", "lang", quality_rules.counts_udf("text").alias("f")).select("doc_id", "lang", "f.*")
    lab = labels(spark, [(i, int(i % 1000 < 400), 0) for i, _, _ in docs])
    got = quality_rules.cutoffs(featured, lab)
    assert len(got) == 70 and all("symbols" in x for x in got.values())


def test_rules_on_awkward_rows(spark):
    docs = awkward(spark)
    assert quality_rules.score(docs, labels(spark)).count() == docs.count()
    kept = quality_rules.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    assert quality_rules.keep_good(empty(spark), labels(spark)).count() == 0


# -- decontamination -------------------------------------------------------

PLAIN = "how many of the 14 red boxes were left on the shelf when the last 3 of them had gone to the other room"
ITEM = "Tom bought 12 apples and 30 pears at the big market in Paris for 45 dollars before he met Anna and gave her 12 apples"
SAME = "Lucy bought 7 apples and 81 pears at the big market in London for 99 dollars before he met Kate and gave her 7 apples"
ODD = "Lucy bought 7 apples and 81 pears at the big market in London for 99 dollars before he met Kate and gave her 9 apples"


def test_leaks_with_other_values(spark):
    docs = [(1, f"{words(1, 40)}. {ITEM} {words(2, 40)}"), (2, f"{words(3, 30)}. {SAME}. {words(4, 9)}"), (3, ODD), (4, words(5, 300)), (5, PLAIN.upper()), (6, "apples and pears at the big market"), (7, None)]
    bench = spark.createDataFrame([(9, ITEM), (8, None), (7, "a b"), (6, PLAIN)], "item_id long, text string")
    for block in (4_000_000, 1):  # one block, or one an item
        got = {(r.doc_id, r.item_id): r.changed for r in decontamination.find_leaks(spark.createDataFrame(docs, TEXT), bench, block=block).collect()}
        assert set(got) == {(1, 9), (2, 9), (5, 6)} and got[1, 9] == 0 and got[2, 9] > 5
        assert sorted(r.doc_id for r in decontamination.drop_leaks(spark.createDataFrame(docs, TEXT), bench, block=block).collect()) == [3, 4, 6, 7]


def test_exact_passages_against_search(spark):
    items = [(k, words(1000 + k, 30)) for k in range(20)]
    docs = [(k, f"{words(k, 60)} {items[k % 20][1]} {words(k + 500, 60)}" if k % 3 == 0 else words(k, 150)) for k in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, TEXT), bench).collect()}
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


def test_leaks_of_awkward_rows(spark):
    bench = spark.createDataFrame([(1, words(1, 80)), (None, "x")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.find_leaks(awkward(spark), bench).collect()) == [4, 4, 4, 5]
    kept = decontamination.drop_leaks(awkward(spark), bench)
    assert kept.columns == awkward(spark).columns and kept.count() == awkward(spark).count() - 4
    nothing = bench.limit(0)
    assert decontamination.find_leaks(awkward(spark), nothing).count() == 0 and decontamination.drop_leaks(awkward(spark), nothing).count() == awkward(spark).count()
    assert decontamination.find_leaks(empty(spark), bench).count() == 0


# -- personal data ---------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for kind, pattern, ok in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(out)


PERSONAL = [
    "a@b.c_d@e.f a.b@c.d.e@f.g", "x..@y.z-.w 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 é 1.2.3.4", "4111 1111-1111 1111 12 +1 (234) 567-8901 x +12345678901234567",
    "9" * 20_000, "b" * 50_000, "+1 2 3 4 5 6 7 8 9 0 ()" + " " * 9000, None, "", "1.2.3.4" * 300, "4 1 1 1" * 500, "ÄÖ💥 q@r.s 4111111111111111", "no.one@ @x.y a@b",
]


def test_base_spans_are_the_plain_patterns(spark):
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(enumerate(PERSONAL)), TEXT)).collect()}
    for k, text in enumerate(PERSONAL):
        want = plain_base(text)
        said = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in want)
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert tuple(got[k])[1:5] == tuple(sum(x[1] == j for x in want) for j in range(4))
        assert set(said.split(",")) - {""} <= set(got[k].spans.split(","))


ZEROS = ["10.0.0.1 127.0.0.1, 192.168.0.12", "0.0.0.0", "000.00.0.0 00.0256.0.1 10.0.0.256", "a0.0.0.0b 1.2.3.0.", "0" * 4_000 + ".1.2.3", "0" * 4_000 + ".0.0.300", "255.255.255.0 0.250.249.100"]


def test_addresses_with_zero_parts_are_found(spark):
    docs = spark.createDataFrame(list(enumerate(ZEROS)), TEXT)
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    for k, text in enumerate(ZEROS):
        want = plain_base(text)
        said = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in want)
        assert got[k].n_ip == sum(x[1] == 1 for x in want)
        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert pii.redact(docs.where("doc_id = 0")).first().text == "[IP] [IP], [IP]"


def test_weak_labels_find_secrets_and_leave_hashes(spark):
    key = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    docs = [(k, f'{words(k, 9)} token = "{key(k)}" {words(k, 5)}') for k in range(60)] + [(100 + k, f"see commit abc{k}defabcdefgh{k}xyz and order 123456789{k % 10}") for k in range(60)]
    docs += [(200 + k, "Dear Mr. John Smith, hello") for k in range(5)]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(docs, TEXT)).collect()}
    assert all("secret:" in got[k] for k in range(60))
    assert sum("secret:" in got[100 + k] for k in range(60)) == 0


def test_redaction_replaces_spans_only(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (234) 567-8901!", 33, "a"), (2, "nothing", 7, "b"), (3, None, None, None)], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]!" and got[1].n_chars == len(got[1].text)
    assert tuple(got[2]) == (2, "nothing", 7, "b") and tuple(got[3]) == (3, None, None, None)


def test_redaction_of_very_many_spans(spark):
    text = "é ".join(f"x{k}@b{k}.org 10.0.0.{k % 300}," for k in range(1500))
    got = pii.redact(spark.createDataFrame([(1, text), (2, "no"), (3, None)], TEXT)).orderBy("doc_id").collect()
    want = "é ".join(f"[EMAIL] {'[IP]' if k % 300 < 256 else f'10.0.0.{k % 300}'}," for k in range(1500))
    assert [r.text for r in got] == [want, "no", None]


def test_no_python_in_the_plan(spark, tmp_path):
    import contextlib
    import io

    awkward(spark).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pii.report(docs).explain("formatted")
        pii.redact(docs).explain("formatted")
    assert not re.search("Python|Pandas|Arrow", out.getvalue())


def test_personal_data_of_awkward_rows(spark):
    docs = awkward(spark)
    assert pii.report(docs).count() == docs.count() and pii.report(empty(spark)).count() == 0
    same = pii.redact(docs)
    assert same.schema == docs.schema and same.count() == docs.count() and pii.redact(empty(spark)).count() == 0


def test_em_tells_reliable_votes():
    rows = [(4, (1, 1, 1, 1), 300), (4, (-1, 0, -1, -1), 500), (4, (1, 0, 1, 1), 100), (4, (-1, -1, -1, 1), 60)]
    w = pii.estimate(rows)
    score = lambda v: w[0] + sum(a * b for a, b in zip(w[1:5], v)) + w[5 + 4]
    assert score((1, 1, 1, 1)) > 0 > score((-1, 0, -1, -1)) and pii.estimate([])[0] == 0


DENSE = ["What is 12 + 7 * 3 - 18 / 6 + 45 - 9?", "Convert 3 hours 25 minutes 40 seconds to seconds.", "Alice Smith met Bob Jones in New York on 5 May 2010.", "5 kg 30 m"]


def test_items_dense_in_numbers_and_names_leak_when_copied(spark):
    bench = spark.createDataFrame(list(enumerate(DENSE)), "item_id long, text string")
    docs = [(k, f"{words(k, 30)}. {t} {words(90 + k, 30)}") for k, t in enumerate(DENSE)]
    docs += [(10, f"{words(10, 30)}. Convert 4 hours 15 minutes 20 seconds to seconds."), (11, "6 kg 30 m"), (12, "It is 12 + 7 * 3 - 18, and 5 May 2010 in New York.")]
    df = spark.createDataFrame(docs, TEXT)
    got = {(r.doc_id, r.item_id): (r.coverage, r.changed) for r in decontamination.find_leaks(df, bench).collect()}
    assert got == {(k, k): (1.0, 0) for k in range(len(DENSE))}
    assert {r.doc_id for r in decontamination.drop_leaks(df, bench).collect()} == {10, 11, 12}


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_go_by_shingle_similarity(spark):
    docs = []
    for k in range(40):
        w = words(300 + k, 100).split()
        docs.append((10 * k, " ".join(w)))
        for j, n in enumerate((1, 2, 4)):  # words changed, well apart
            docs.append((10 * k + j + 1, " ".join(f"new{k}x{j}" if p % 25 == 12 and p < 25 * n else x for p, x in enumerate(w))))
    root = {i: i for i, _ in docs}
    for i, a in docs:
        for j, b in docs:
            if i < j and jaccard(a, b) >= 0.8:
                old, new = sorted((root[i], root[j]))[::-1]
                root = {x: new if r == old else r for x, r in root.items()}
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, TEXT)).collect()}
    assert len(set(root.values())) == 80 and got <= set(root.values())
    assert {10 * k for k in range(40)} <= got and len(got) >= 78  # SimHash may link more, as op6 does


def test_no_text_vanishes_with_a_repeated_id(spark):
    x, y = words(501, 80), words(502, 80)
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame([(5, x), (5, y), (3, y), (7, x)], TEXT)).collect()]
    assert {t for _, t in got} == {x, y} and len(got) == 2 == len({i for i, _ in got})
