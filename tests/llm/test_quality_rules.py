from __future__ import annotations

import math
import re
from collections import Counter

from rubato.llm import quality_rules as q

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    seen: set[str] = set()
    dups = 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked)


def check(rows, texts):
    for r, text in zip(rows, texts, strict=True):
        n, *_, repeats = want = brute(text)
        assert tuple(r[k] for k in NAMES) == want
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_counts_and_risk_on_labelled_documents(spark, small_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    rows = q.op6_quality_rules(spark, small_dir).collect()
    assert len(rows) == len(docs)
    check(rows, [docs[r.doc_id].text for r in rows])
    good = {r.doc_id for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("quality = 1").collect()}
    by_lang = Counter((r.lang, r.kept) for r in rows if r.doc_id in good and not r.base_failed)
    for lang in {k for k, _ in by_lang}:
        assert by_lang[lang, False] <= q.ALPHA * (by_lang[lang, False] + by_lang[lang, True])


def test_awkward_rows(spark, awkward, no_rows, no_labels):
    features = q.rule_features(awkward, ("doc_id", "lang", "text"))
    rows = features.withColumn("base_failed", q.base_failed()).withColumn("kept", ~q.base_failed()).collect()
    check(rows, [r.text for r in rows])
    judged = q.apply_quality_rules(awkward, no_labels)
    assert judged.count() == awkward.count()
    assert judged.where("kept <> (not base_failed)").count() == 0  # nothing is certified without labels
    kept = q.accepted_documents(awkward, no_labels)
    assert kept.columns == awkward.columns and kept.count() == judged.where("kept").count()
    assert q.apply_quality_rules(no_rows, no_labels).count() == 0


def test_binomial_tail_is_exact():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.25), (10, 10, 0.5)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(q.binomial_cdf(k, n, p) - exact) < 1e-12


def test_cutoffs_stop_where_the_bound_fails():
    n = len(q.CUTOFFS)
    assert q.certified_cutoff([0] * n, [0] * 20 + [5] * (n - 20), 5, 0.0125, 0.001) == math.inf  # too few labels
    free = q.certified_cutoff([0] * n, [0] * 20 + [5] * (n - 20), 5000, 0.0125, 0.001)
    assert free == q.CUTOFFS[20]
    steep = q.certified_cutoff([0] * 30 + [4000] * (n - 30), [1] * n, 5000, 0.0125, 0.001)
    assert steep == q.CUTOFFS[0]


def test_contradicting_labels_are_left_out(spark):
    features = spark.createDataFrame([(i, "en", 100, 500, 0, 0, 0, 5, 0, 400) for i in range(50)], "doc_id long, lang string, " + q.FEATURES)
    labels = spark.createDataFrame([(i, x) for i in range(50) for x in (0, 1)], "doc_id long, quality int")
    assert q.select_cutoffs(features, labels).count() == 0


def test_equal_texts_are_one_trial(spark):
    """Copies of a good text under many ids, and repeated rows, give no evidence beyond one."""
    row = lambda i, h, upper: (i, "en", h, 100, 500, 0, 0, 0, 5, upper, 400)
    schema = "doc_id long, lang string, text_hash long, " + q.FEATURES
    good, bad = [row(i, 1, 0) for i in range(4000)], [row(i, i, 399) for i in range(5000, 5050)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000)) for r in good + bad], "doc_id long, quality int")
    found = q.select_cutoffs(spark.createDataFrame(good + bad, schema), labels).first()
    assert all(found[r] == math.inf for r in q.RULES)
    apart = [row(i, -i, 0) for i in range(4000)]
    assert q.select_cutoffs(spark.createDataFrame(apart + bad, schema), labels).first()["upper_share"] < 1
    again = spark.createDataFrame([good[0][:2] + good[0][3:]] * 4000 + [b[:2] + b[3:] for b in bad], "doc_id long, lang string, " + q.FEATURES)
    assert q.select_cutoffs(again, labels).first()["upper_share"] == math.inf
