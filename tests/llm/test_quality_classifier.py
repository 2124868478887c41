from __future__ import annotations

import zlib

import numpy as np
from rubato.llm import quality_classifier as c


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = c.op9_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([(s >= 0.5) == y for s, y in test]) > 0.93
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", c.F.when(c.held_out(), 1 - c.F.col("quality")).otherwise(c.F.col("quality")))
    one, two = c.fit_on(docs, labels), c.fit_on(docs, flipped)
    assert np.array_equal(one.vectors, two.vectors) and np.array_equal(one.out, two.out)


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    m = c.fresh_model()
    docs = [c.passages(" ".join(rng.choice(["a", "b", "Cc", "d!"], n))) for n in (5, 200, 0, 70)]
    x, y = c.Bags.of(docs), np.array([1.0, 0, 1, 0])
    loss = lambda: float(-np.mean(np.log(np.where(y == 1, p := c.forward(m, x)[0], 1 - p))))
    grads = c.gradients(m, x, y)
    for name, g in grads.items():
        value = getattr(m, name)
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = value[i]
        value[i] = old + 1e-5
        up = loss()
        value[i] = old - 1e-5
        down = loss()
        value[i] = old
        assert abs((up - down) / 2e-5 - g[i]) < 1e-6


def test_scores_do_not_depend_on_the_batch():
    m = c.fresh_model()
    texts = ["a b c", None, "x " * 500, "", "y z"]
    alone = [float(c.score_texts(m, [t])[0]) for t in texts]
    assert np.allclose(c.score_texts(m, texts), alone, atol=1e-12)


def test_awkward_rows(spark, awkward, no_rows, no_labels):
    model = c.fit_on(awkward, no_labels)
    assert model.prior == 0.5
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = c.fit_on(awkward, labels)
    assert c.score_documents(awkward, model).where("score between 0 and 1").count() == awkward.count()
    kept = c.accepted_documents(awkward, model, 0.0)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert c.score_documents(no_rows, model).count() == 0


def test_what_the_fit_gathers_of_a_document_is_bounded():
    words = " ".join(f"w{i}" for i in range(64 * 64 * 40 + 5))
    full, starts, stats = c.passages(words)
    own, kept = c.spaced(full, starts, stats)
    assert len(own) == 16 * 64 * 64 and len(kept) == 16 * 64 and np.array_equal(own[:64], full[:64])
    assert np.array_equal(c.spaced(full[:9000], starts[:141], stats[:141])[0], full[:9000])
