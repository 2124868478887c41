"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose score lies above a cutoff.  For every
stratum (language) and rule the candidate cutoffs are tested from the most
lenient to the strictest: a cutoff is certified while the exact binomial test
rejects "at least ``alpha / n_rules`` of the good documents of this stratum
are rejected by this rule", which is the same as the Clopper-Pearson upper
bound lying below that rate.  Testing in a fixed order needs no correction
along the cutoffs; over all strata and rules, Bonferroni's correction bounds
by ``delta`` the chance that any certified cutoff breaks its promise.  Summed
over the rules, at most ``alpha`` of a stratum's good documents are rejected.

A stratum without enough labels to certify anything rejects nothing by rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, discard, materialise, sent_back, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bound on the share of a stratum's good documents that the rules reject.
ALPHA = 0.05
#: Chance that any of the certified cutoffs breaks its bound.
DELTA = 0.05
#: Rules and their candidate cutoffs, lenient to strict.
RULES = ("symbols_per_word", "upper_share", "dup_line_share", "repeat_share")
CUTOFFS = tuple(round(1 - 0.025 * i, 3) for i in range(40))
#: Weight of a good document against a bad one when a certified cutoff is chosen.
GOOD_WEIGHT = 5

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\f\r"
_UPPER = slice(ord("A"), ord("Z") + 1)
_LOWER = slice(ord("a"), ord("z") + 1)

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    u = len(ids)
    if u == n:
        return 0
    pairs = a[:-1] * u + a[1:]
    if u >= 1 << 20:  # three numbers no longer fit in 63 bits: number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * u + a[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    marked = np.zeros(n, bool)
    for shift in range(3):
        marked[shift : n - 2 + shift] |= again
    return int(marked.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts of ``FEATURES`` for one whole text; all 0 for null."""
    if not text:
        return (0,) * 8
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - int(counts[list(SPACES)].sum())
    upper = int(counts[_UPPER].sum())
    return (
        len(words), chars, int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), upper, upper + int(counts[_LOWER].sum()),
    )


def rule_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text: tuple[str, ...] = ("text",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the counts of every whole text, which ``text`` names, within a struct too."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sent_back(batch):
                columns = zip(*(text_features(t.as_py()) for t in column_of(part, text)), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), *(pa.array(c, pa.int64()) for c in columns)], [*keep, *names]
                )

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*dict.fromkeys([*keep, text[0]])).mapInArrow(run, f"{schema}, {FEATURES}")


def scores() -> dict[str, F.Column]:
    """Rule scores from the counts; 0 where there is nothing to divide by."""
    share = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "n_letters"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P[Binomial(n, p) <= k]."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    return min(1.0, math.fsum(map(math.exp, logs)))


def certified_cutoff(good: list[int], bad: list[int], n_good: int, rate: float, level: float) -> float:
    """The chosen cutoff, infinite for none.

    ``good`` and ``bad`` count the labelled documents that each cutoff of
    ``CUTOFFS`` rejects.  Among the certified ones, that with the most bad
    documents less ``GOOD_WEIGHT`` times the good ones; the most lenient of
    equals.
    """
    best, cutoff = 0, math.inf
    for c, g, b in zip(CUTOFFS, good, bad, strict=True):
        if n_good == 0 or binomial_cdf(g, n_good, rate) > level:
            break
        if b - GOOD_WEIGHT * g > best:
            best, cutoff = b - GOOD_WEIGHT * g, c
    return cutoff


def select_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff column per rule) for each stratum that has labels.

    ``labels`` has doc_id and quality (1: good); rows that contradict each
    other on a document are left out.  Documents that fail the base rules are
    no part of the test, as no cutoff decides on them.  The binomial bound needs
    independent trials, so equal texts (``features`` has their text_hash) of one
    stratum and label count once, whatever their doc_ids; without a text_hash,
    rows of one doc_id do.  Only counts by stratum, rule, cutoff and label meet
    in one group.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q1")).where("quality = q1").drop("q1")
    values = scores()
    # the number of cutoffs, from the lenient end, that the document passes
    passed = lambda s: F.size(F.filter(F.array(*[F.lit(c) for c in CUTOFFS]), lambda c: s <= c))
    trial = "text_hash" if "text_hash" in features.columns else "doc_id"
    rated = features.where(~base_failed()).join(known, "doc_id").select(
        F.col("lang").alias("stratum"), "quality", F.col(trial).alias("trial"), *[passed(values[r]).alias(r) for r in RULES]
    ).dropDuplicates(["stratum", "quality", "trial"])
    long = rated.select(
        "stratum", "quality", F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("passed")) for i, r in enumerate(RULES)])).alias("x")
    )
    counts = materialise(long.groupBy("stratum", "quality", "x.rule", "x.passed").agg(F.count(F.lit(1)).alias("n")), "rule-counts")
    n_strata = counts.select("stratum").distinct().count()
    rate, level = alpha / len(RULES), delta / max(1, n_strata * len(RULES))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        row: dict[str, object] = {"stratum": pdf["stratum"].iloc[0]}
        for i, rule in enumerate(RULES):
            own = pdf[pdf["rule"] == i]
            by = {q: own[own["quality"] == q].groupby("passed")["n"].sum().reindex(range(len(CUTOFFS) + 1), fill_value=0).cumsum() for q in (0, 1)}
            # cutoff number j rejects the documents that pass j cutoffs or fewer
            good, bad = ([int(by[q].iloc[j]) for j in range(len(CUTOFFS))] for q in (1, 0))
            row[rule] = certified_cutoff(good, bad, int(by[1].iloc[-1]), rate, level)
        return pd.DataFrame([row])

    kind = features.schema["lang"].dataType.simpleString()
    return counts.groupBy("stratum").applyInPandas(choose, f"stratum {kind}, " + ", ".join(f"{r} double" for r in RULES))


def judge(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed and kept to the counts.

    Strata are languages, null included; one without a row in ``cutoffs``
    rejects by the base rules alone.
    """
    limits = cutoffs.select(F.col("stratum"), *[F.col(r).alias(f"_max_{r}") for r in RULES])
    joined = features.join(limits, features["lang"].eqNullSafe(limits["stratum"]), "left")
    fine = F.lit(True)
    for rule, score in scores().items():
        fine = fine & (score <= F.coalesce(F.col(f"_max_{rule}"), F.lit(float("inf"))))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fine).drop(
        "stratum", *[f"_max_{r}" for r in RULES]
    )


def hashed_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash and the counts of every row of ``docs``, written once."""
    return materialise(rule_features(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash")), ("doc_id", "lang", "text_hash")), "rule-features")


def apply_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict of every document.

    Null and empty texts have 0 words and fail.  Repeated rows are judged
    alike, each on its own.  An empty input gives an empty result; columns of
    ``docs`` besides doc_id, text and lang are ignored.
    """
    features = hashed_features(docs)
    return judge(features, materialise(select_cutoffs(features, labels), "rule-cutoffs"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that the rules keep.

    The first pass counts every row, and its counts alone are joined to the
    labels; the second judges every row as it streams by.  So no text is
    shuffled, however many labels there are.
    """
    features = hashed_features(docs)
    cutoffs = materialise(select_cutoffs(features, labels), "rule-cutoffs")
    discard(features)
    packed = docs.select(F.struct("*").alias("_doc"), "lang")
    return judge(rule_features(packed, ("_doc", "lang"), ("_doc", "text")), cutoffs).where("kept").select("_doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_upper", "n_letters", "lang",
    )
