"""Personal data by weak supervision, in DataFrame functions alone.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Candidates of three
more kinds (secret, account, name) are voted on by four labelers: the candidate's shape, a
gazetteer of words before it, the characters around it, and its mix of characters. Expectation-
maximisation over the counts of vote patterns (81 a kind at most) estimates how reliable each
labeler is; its posteriors train a logistic span classifier over the same votes, whose weights go
back into the plan as an expression. Only the pattern counts ever leave the executors.

The patterns are written so that Java's matcher neither recurses nor scans a long run twice: they
match what the plain patterns match, but for runs of digits too short to be kept.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

KINDS = ("email", "ip", "card", "phone", "secret", "account", "name")
LABELERS = 4
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){8,}+",  # whole runs of digits, of nine or more
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++)?+",
}
_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"  # no digit but zeros is a zero
_IP_OK = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# Words that speak for or against a candidate when they come before it.
FOR_WORDS = {
    "secret": "token key secret password passwd pwd api apikey auth bearer credential access",
    "account": "account acct iban konto cuenta compte ssn passport customer card",
    "name": "mr mrs ms dr prof herr frau señor señora monsieur madame",
}
AGAINST_WORDS = {"secret": "sha sha1 sha256 md5 commit checksum digest etag", "account": "isbn order version page year phone tel", "name": "the"}


_SPANS = "array<struct<start:int,end:int,word:string>>"
_RUN = 128


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, word>> of a pattern's matches, in code points.

    Places are running sums over matches and the gaps before them. They are built in runs of _RUN
    matches, which are then moved to their place, so the work grows in proportion to the matches.
    """
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(words.alias("word"), F.slice(gaps, 1, F.size(words)).alias("gap"))
    none = F.expr(f"cast(array() as {_SPANS})")

    def step(acc: Column, x: Column) -> Column:
        start = (acc["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.length(x["word"])).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["word"].alias("word")))).alias("out"))

    def run(k: Column) -> Column:
        return F.aggregate(F.slice(pairs, k, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def move(acc: Column, r: Column) -> Column:
        moved = F.transform(r["out"], lambda s: F.struct(
            (s["start"] + acc["at"]).cast("int").alias("start"), (s["end"] + acc["at"]).cast("int").alias("end"), s["word"].alias("word")))
        return F.struct((acc["at"] + r["at"]).cast("int").alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    runs = F.transform(F.sequence(F.lit(1), F.size(words), F.lit(_RUN)), run)
    placed = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{_SPANS}>)").alias("out")), move)
    return F.when(F.size(words) > 0, F.flatten(placed["out"])).otherwise(none)


def _guarded(text: Column, when: Column, pattern: str) -> Column:
    return F.when(when, _spans(text, pattern)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        x = F.substring(digits, k, F.lit(1)).cast("int")
        x = F.when((n - k) % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return total + x

    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _tag(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _votes(text: Column, x: Column, kind: str) -> Column:
    """The four labelers' votes: 1, 0 or -1 each."""
    word, digits = x["word"], _digits(x["word"])
    left = F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
    # the last word before the candidate, past quotes and equal signs; names carry theirs themselves
    near = F.lower(F.regexp_extract(word if kind == "name" else left, r"^([\p{L}]++)" if kind == "name" else r"([\p{L}][\p{L}0-9]*+)[^\p{L}0-9]{0,6}$", 1))
    before, after = F.substring(left, -1, 1), F.substring(text, x["end"] + 1, F.lit(1))
    share = F.length(digits) / F.length(word)
    kinds = F.size(F.array_distinct(F.split(word, "")))
    if kind == "secret":
        shape = F.when(word.rlike(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$|^(?:sk|pk|ghp|gho|AKIA|xox)[_A-Za-z0-9]+$"), 1).when(F.length(word) < 20, -1).otherwise(0)
        mix = F.when((kinds >= 8) & share.between(0.15, 0.85), 1).otherwise(-1)
    elif kind == "account":
        shape = F.when(word.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{4}(?:[ -][0-9]{4})+$"), 1).when(F.length(digits) < 9, -1).otherwise(0)
        mix = F.when((kinds >= 4) & (F.length(digits) >= 9), 1).otherwise(-1)
    else:
        shape = F.when(word.rlike(r" \S+ \S+$"), 1).otherwise(0)
        mix = F.when(F.length(word) >= 8, 1).otherwise(0)
    listed = F.when(near.isin(FOR_WORDS[kind].split()), 1).when(near.isin(AGAINST_WORDS[kind].split()), -1).otherwise(0)
    around = F.when(before.isin('"', "'", "=", ":", "(") | (before.isin(" ") & after.isin(" ", "", ",", ".")), 1).when(before.rlike(r"[\p{L}0-9@/]") | after.rlike(r"[\p{L}0-9@/]"), -1).otherwise(0)
    return F.array(*[v.cast("int") for v in (shape, listed, around, mix)])


def _found(text: Column) -> tuple[Column, Column]:
    """(base spans, candidates with votes) of a text, each array<struct<start, kind, end[, votes]>>."""
    some = text.rlike("[0-9]")
    at, plus, dot = F.contains(text, F.lit("@")), F.contains(text, F.lit("+")), F.contains(text, F.lit("."))
    runs = _guarded(text, some, PATTERNS["card"])
    card = F.filter(runs, lambda x: _luhn(_digits(x["word"])))
    base = F.concat(
        _tag(_guarded(text, at, PATTERNS["email"]), "email"),
        _tag(F.filter(_guarded(text, some & dot, PATTERNS["ip"]), lambda x: x["word"].rlike(_IP_OK)), "ip"),
        _tag(card, "card"),
        _tag(F.filter(_guarded(text, some & plus, PATTERNS["phone"]), lambda x: F.length(_digits(x["word"])).between(10, 15)), "phone"),
    )

    def voted(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), _votes(text, x, kind).alias("votes")
        ))

    secret = F.filter(_guarded(text, some, PATTERNS["secret"]), lambda x: x["word"].rlike("[0-9]") & x["word"].rlike("[A-Za-z]"))
    account = F.filter(runs, lambda x: F.length(_digits(x["word"])).between(9, 19) & ~_luhn(_digits(x["word"])))
    extra = F.concat(voted(secret, "secret"), voted(account, "account"), voted(_guarded(text, F.lit(True), PATTERNS["name"]), "name"))
    return base, extra


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> list[float]:
    """Weights of the span classifier from (kind, votes, count) rows: bias, labelers, kinds.

    EM for two classes with labelers independent given the class: each labeler has the probability
    of each vote under each class, started at 0.8 for the right one; each kind has its own share.
    Then logistic regression on the posteriors by gradient steps with a little ridge.
    """
    if not patterns:
        return [0.0] * (1 + LABELERS + len(KINDS))
    prob = [[{1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.15, 0: 0.35, -1: 0.5}] for _ in range(LABELERS)]
    share = {k: 0.5 for k, _, _ in patterns}
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (kind, votes, _) in enumerate(patterns):
            a, b = log(share[kind]), log(1 - share[kind])
            for p, v in zip(prob, votes):
                a, b = a + log(p[0][v]), b + log(p[1][v])
            post[i] = 1 / (1 + exp(max(-50.0, min(50.0, b - a))))
        for k in share:
            own = [(q, n) for (kind, _, n), q in zip(patterns, post) if kind == k]
            share[k] = (1 + sum(q * n for q, n in own)) / (2 + sum(n for _, n in own))
        for j in range(LABELERS):
            for c in (0, 1):
                start = (6, 3, 1) if c == 0 else (1.5, 3.5, 5)  # prior counts keep the classes' meaning
                seen = {v: s + sum((q if c == 0 else 1 - q) * n for (_, votes, n), q in zip(patterns, post) if votes[j] == v) for v, s in zip((1, 0, -1), start)}
                total = sum(seen.values())
                prob[j][c] = {v: x / total for v, x in seen.items()}
    weights, total = [0.0] * (1 + LABELERS + len(KINDS)), sum(n for _, _, n in patterns)
    for _ in range(3000):
        slope = [1e-4 * w for w in weights]
        for (kind, votes, n), q in zip(patterns, post):
            x = [1.0, *map(float, votes), *[float(k == kind) for k in range(len(KINDS))]]
            p = 1 / (1 + exp(-sum(w * y for w, y in zip(weights, x))))
            for j, y in enumerate(x):
                slope[j] += (p - q) * y * n / total
        weights = [w - s for w, s in zip(weights, slope)]
    return weights


def _accepted(extra: Column, weights: list[float]) -> Column:
    """Candidates that the classifier takes as personal data."""
    kinds = F.array(*[F.lit(w) for w in weights[1 + LABELERS :]])

    def score(x: Column) -> Column:
        total = F.lit(weights[0]) + F.element_at(kinds, x["kind"] + 1)
        for j in range(LABELERS):
            total = total + F.lit(weights[1 + j]) * x["votes"][j]
        return total

    return F.transform(F.filter(extra, lambda x: score(x) > 0), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def learn(found: DataFrame) -> list[float]:
    """The classifier's weights from a table with candidates in column extra (rows of votes are few)."""
    rows = found.select(F.explode("extra").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n"))
    return estimate(sorted((r.kind, tuple(r.votes), r.n) for r in rows.collect()))  # at most 3 * 81 rows


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of struct<start, kind, end>, sorted, by code points.

    ``kind`` is a place in KINDS. Null texts are empty and have none. Repeated rows come back each,
    rows without doc_id too. Other columns are ignored, whatever their names. An empty table gives
    an empty result; without candidates nothing is added to the base.
    """
    t = documents.select("doc_id", _text(F.col("text")).alias("text"))
    base, extra = _found(F.col("text"))
    found = written(t.select("doc_id", F.array_sort(base).alias("base"), extra.alias("extra")), "spans")
    accepted = _accepted(F.col("extra"), learn(found))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", accepted)).alias("spans"))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) from ``find``."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find(documents).select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with each found span replaced by its kind in brackets, and n_chars to match.

    Overlapping spans are replaced from the first start on, under the kind of the first. Rows and
    columns stay as they are; a text without spans, or null, is not touched.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    base, extra = _found(_text(F.col("row.text")))
    found = written(documents.select(F.struct(*columns).alias("row")).select("row", base.alias("base"), extra.alias("extra")), "found")
    spans = F.array_sort(F.concat("base", _accepted(F.col("extra"), learn(found))))
    marked = found.select("row", spans.alias("spans"))
    names, text = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("row.text")

    def run(acc: Column, k: Column) -> Column:
        """The text from where the last run ended to where this one does; only this part is cut again and again."""
        own = F.slice("spans", k, F.lit(_RUN))
        end = F.greatest(acc["at"], F.array_max(F.transform(own, lambda x: x["end"])))
        part = F.substring(text, acc["at"] + 1, end - acc["at"])

        def step(a: Column, x: Column) -> Column:
            new = F.concat(a["out"], F.substring(part, a["at"] - acc["at"] + 1, x["start"] - a["at"]), F.element_at(names, x["kind"] + 1))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

        done = F.aggregate(own, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    starts = F.sequence(F.lit(1), F.size("spans"), F.lit(_RUN))
    done = F.aggregate(starts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), run)
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    out = marked.select("row", clean.alias("clean"), (F.size("spans") > 0).alias("hit"))
    return out.select(*[
        F.col("clean").alias(c) if c == "text"
        else F.when(F.col("hit"), F.length("clean")).otherwise(F.col("row.n_chars")).cast(documents.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`") for c in documents.columns
    ])
