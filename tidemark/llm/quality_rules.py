"""Quality rules with risk-controlled thresholds.

Each text gets a few rates in thousandths; a rule rejects rates over its cutoff. For each stratum (language)
a path of joint cutoffs, one for each rule, leads from lenient to strict: a step lowers the cutoff of the
rule that gains most bad texts for the good ones it seems to cost. The path comes from bad
labels, unlabelled texts and a quarter of the good labels. The other good labels are the holdout: along the path
a step is certified while the exact binomial (Clopper-Pearson) test shows at most ``risk`` false
rejections by all rules together at ``level`` / strata, and the walk ends at the first that fails. This
fixed sequence and the shared level hold for all strata at once, so whatever is chosen among
certified steps keeps the bound. Chosen is the step that parts bad from good labels best, the more
lenient on ties. A stratum with too few labels to certify anything has no cutoffs, and column
``certified`` says so row by row.

The counts cover every document; what reaches the driver are tables of rates by stratum and rule, for strata
with enough good labels only, so its size is bounded by the labels, not by the documents.
"""

from __future__ import annotations

from math import ceil, exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import TEXT_ROWS, release, written

SPACES, SYMBOLS, CAPITALS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91))
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_capitals", "n_marks")
RULES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "long_words")
RISK, LEVEL, SLOPE = 0.03, 0.05, 2.0


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; windows are compared by 64-bit hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(window):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    w ^= w >> np.uint64(29)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The BASE and EXTRA counts of one whole text; null counts as empty."""
    raw = (text or "").encode()
    words, dense = raw.split(), raw.translate(None, SPACES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = dense.translate(None, SYMBOLS)
    return (
        len(words), len(text or "") - (len(raw) - len(dense)), len(dense) - len(without), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(dense) - len(dense.translate(None, CAPITALS)), dense.count(b"!") + dense.count(b"?"),
    )


@F.pandas_udf(StructType([StructField(x, LongType()) for x in BASE + EXTRA]))
def counts_udf(text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(np.array([counts(x) for x in text], np.int64).reshape(-1, len(BASE + EXTRA)), columns=[*BASE, *EXTRA])
    release()
    return out


def base_failed(f) -> Column:
    return (f("n_words") < MIN_WORDS) | (100 * f("n_repeat_words") > REPEAT_PERCENT * f("n_words"))


def rates(f) -> dict[str, Column]:
    """Each rule's rate, a whole number from 0 to 1000; ``f`` gives a count's column."""
    share = lambda a, b: F.least(F.lit(1000), F.floor(F.lit(1000) * a / F.greatest(F.lit(1), b))).cast("int")
    return {
        "symbols": share(f("n_symbols"), f("word_chars")), "dup_lines": share(f("n_dup_lines"), f("n_lines")),
        "repeats": share(f("n_repeat_words"), f("n_words")), "capitals": share(f("n_capitals"), f("word_chars")),
        "marks": share(f("n_marks"), f("word_chars")), "long_words": share(f("word_chars"), f("n_words") * 100),
    }


def certified(rejected: int, good: int, risk: float, level: float) -> bool:
    """Whether ``rejected`` of ``good`` shows a rate of at most ``risk``: P(X <= rejected) <= level."""
    if rejected >= good * risk:
        return False
    base = lgamma(good + 1)
    at = lambda k: base - lgamma(k + 1) - lgamma(good - k + 1) + k * log(risk) + (good - k) * log1p(-risk)
    total = 0.0
    for k in range(rejected, -1, -1):  # largest terms first; the rest is negligible once terms vanish
        term = exp(at(k))
        total += term
        if total > level or term < total * 1e-17:
            break
    return total <= level


def path(look: np.ndarray, bad: np.ndarray, share: float, risk: float = RISK) -> np.ndarray:
    """Cutoffs (step, rule), never rising along the steps, from counts (rule, rate); 1000 rejects nothing.

    ``look`` counts texts of which about ``share`` are bad, ``bad`` bad ones. Each rule's moves are the corners of
    its hull of bad against good texts rejected; moves of all rules follow one another by their slope, down to
    ``SLOPE`` and as long as the good texts they seem to reject are within twice the risk.
    """
    top = look.shape[1] - 1
    over = lambda x: (x[:, ::-1].cumsum(axis=1)[:, ::-1] - x) / np.maximum(1, x.sum(axis=1, keepdims=True))
    b = over(bad)
    g = np.maximum.accumulate(np.maximum(0.0, over(look) - share * b)[:, ::-1], axis=1)[:, ::-1] / (1 - share)
    moves, least = [], 1 / max(1, int(look[0].sum()))
    for r in range(len(look)):
        at, worst = top, np.inf
        while at:
            slope = (b[r, :at] - b[r, at]) / (g[r, :at] - g[r, at] + least)
            to = at - 1 - int(slope[::-1].argmax())  # the more lenient of equal ones
            if slope[to] < SLOPE or b[r, to] <= b[r, at]:
                break
            worst = min(worst, float(slope[to]))
            moves.append((-worst, r, len(moves), to, g[r, to] - g[r, at]))
            at = to
    cuts, out, spent = np.full(len(look), top), [], 0.0
    for _, r, _, to, cost in sorted(moves):
        spent += cost
        if spent > 2 * risk:
            break
        cuts[r] = to
        out.append(cuts.copy())
    return np.array(out, np.int64).reshape(-1, len(look))


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> int | None:
    """The step to take from the numbers of good and bad texts first rejected at each (the last place: never), or None."""
    n_good, n_bad, best, step = int(good.sum()), int(bad.sum()), 0.0, None
    for t, (g, b) in enumerate(zip(good.cumsum()[:-1].tolist(), bad.cumsum()[:-1].tolist())):
        if not certified(g, n_good, risk, level):
            break
        gain = b / max(1, n_bad) - g / max(1, n_good)
        if gain > best + 1e-12:
            best, step = gain, t
    return step


def _stratum(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def cutoffs(featured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[str, dict[str, int]]:
    """stratum -> rule -> cutoff, from ``featured`` (doc_id, lang, counts) and all ``labels``.

    Labels that are null, or that differ for one id, are left out. Texts that fail the base rules
    don't count. Each row of a repeated doc_id counts. Strata that certify nothing are not in the result.
    """
    spark = featured.sparkSession
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("__most")
    ).where("quality = __most").select("doc_id", "quality")
    passed = featured.where(~base_failed(F.col)).select("doc_id", _stratum(F.col("lang")).alias("stratum"), F.array(*rates(F.col).values()).alias("rates"))
    kept_back = F.xxhash64("doc_id", F.lit(4)).bitwiseAND(3) != 0
    role = F.when(F.col("quality") == 0, "bad").when((F.col("quality") == 1) & kept_back, "test").otherwise("look")
    seen = passed.join(lab, "doc_id", "left").select("stratum", "rates", role.alias("role"))
    table = written(seen.groupBy("stratum", "role", "rates").agg(F.count("*").alias("n")), "rates")
    sizes = table.groupBy("stratum").agg(*[F.sum(F.when(F.col("role") == x, F.col("n")).otherwise(0)).alias(x) for x in ("bad", "test")])
    least = ceil(log(level) / log1p(-risk))  # fewer good labels certify nothing, even if none is rejected
    strata = {r.stratum: r.bad / (r.bad + r.test * 4 / 3) for r in sizes.where(F.col("test") >= least).collect()}
    if not strata:
        return {}
    chosen = spark.createDataFrame([(s,) for s in sorted(strata)], "stratum string")
    own = table.join(F.broadcast(chosen), "stratum")  # a row a stratum with that many labels
    flat = own.where("role <> 'test'").select("stratum", "role", "n", F.posexplode("rates").alias("rule", "rate"))
    hist = {s: np.zeros((2, len(RULES), 1001), np.int64) for s in strata}
    for r in flat.groupBy("stratum", "role", "rule", "rate").agg(F.sum("n").alias("n")).collect():  # at most strata * rules * 1001 * 2
        hist[r.stratum][int(r.role == "bad"), r.rule, r.rate] += r.n
    paths = {s: p for s, h in hist.items() if len(p := path(*h, strata[s], risk))}
    if not paths:
        return {}
    steps = spark.createDataFrame([(s, p.T.tolist()) for s, p in sorted(paths.items())], "stratum string, cuts array<array<int>>")
    # cutoffs never rise, so the first step that rejects a rate is the number of steps that don't
    first = F.array_min(F.transform("rates", lambda x, k: F.size(F.filter(F.get("cuts", k), lambda c: c >= x))))
    at = table.where("role <> 'look'").join(F.broadcast(steps), "stratum").select("stratum", "role", "n", first.alias("step"))
    met = {s: np.zeros((2, len(p) + 1), np.int64) for s, p in paths.items()}
    for r in at.groupBy("stratum", "role", "step").agg(F.sum("n").alias("n")).collect():
        met[r.stratum][int(r.role == "bad"), r.step] += r.n
    out = {}
    for s, (good, bad) in met.items():
        if (j := choose(good, bad, risk, level / len(strata))) is not None:
            out[s] = {rule: int(c) for rule, c in zip(RULES, paths[s][j]) if c < 1000}
    return out


def verdict(f, lang: Column, found: dict[str, dict[str, int]]) -> Column:
    """True where a text stays: it passes the base rules and no rate is over its stratum's cutoff."""
    stratum, over = _stratum(lang), F.lit(False)
    for rule, rate in rates(f).items():
        at = {s: x[rule] for s, x in found.items() if rule in x}
        if at:
            table = F.create_map(*[F.lit(y) for s, t in sorted(at.items()) for y in (s, t)])
            over = over | F.coalesce(rate > F.try_element_at(table, stratum), F.lit(False))
    return ~base_failed(f) & ~over


def score(documents: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, BASE counts, base_failed, kept, certified) for every row of ``documents``.

    certified: whether the row's stratum has cutoffs, beyond the base rules.

    Null texts count as empty and fail the base rules. A null lang is a stratum of its own. Rows
    without doc_id are judged but teach nothing. Without labels only the base rules hold. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    featured = written(documents.select("doc_id", "lang", counts_udf("text").alias("f")).select("doc_id", "lang", "f.*"), "counts")
    found = cutoffs(featured, labels, **params)
    return featured.select(
        "doc_id", *BASE, base_failed(F.col).alias("base_failed"), verdict(F.col, F.col("lang"), found).alias("kept"),
        _stratum(F.col("lang")).isin(sorted(found)).alias("certified"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``documents`` that stay, with their columns and no others; each text is counted once."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    counted = written(documents.select(F.struct(*columns).alias("row"), counts_udf("text").alias("f")), "counted", TEXT_ROWS)
    found = cutoffs(counted.select("row.doc_id", "row.lang", "f.*"), labels, **params)
    return counted.where(verdict(lambda c: F.col(f"f.{c}"), F.col("row.lang"), found)).select("row.*")
