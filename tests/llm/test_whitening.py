"""Whitening against numpy on whole tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from rubato.llm import whitening
from rubato.llm.common import table

KIND = "vec_id long, embedding array<float>, component string, n int, x string, d string, whitened string"


def expected(rows: list, components: int = 8) -> tuple[dict, np.ndarray]:
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return {"ids": [i for i, _ in good], "n": n, "deviation": deviation.tolist(), "share": values / values.sum()}, centred @ vectors[:, :components] / np.sqrt(values[:components])


def test_query_equals_numpy(spark, small_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, small_dir, "embeddings").collect()]
    want, whitened = expected(rows)
    found = whitening.op13_whitening(spark, small_dir).collect()
    assert len(found) == 8 * len(rows)
    places = {i: k for k, i in enumerate(want["ids"])}
    got = np.zeros_like(whitened)
    for r in found:
        k, c = places[r["vec_id"]], r["component"] - 1
        got[k, c] = r["whitened"]
        assert r["n"] == want["n"] and r["deviation"] == want["deviation"][k]
        assert r["explained"] == pytest.approx(want["share"][c], rel=1e-6)
        assert 0 <= r["identity_error"] < 1e-8
    signs = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * signs).max() < 1e-6
    assert np.abs(got.T @ got / len(rows) - np.eye(8)).max() < 1e-6


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(v) for v in rng.normal(size=3)]) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [0.0, -float("inf"), 0.0]), (106, [1.0, 2.0])]
    repeated = [good[0], good[0], (None, [0.5, -0.5, 0.25])]
    frame = spark.createDataFrame([(i, v, *["clash", 1, "a", "b", "c"]) for i, v in good + bad + repeated], KIND).repartition(3)
    found = whitening.whiten(frame).collect()
    want, whitened = expected(good + repeated, 3)
    assert len(found) == 3 * 63 and {r["n"] for r in found} == {63}
    assert sorted({(r["vec_id"] if r["vec_id"] is not None else -1) for r in found}) == [-1, *range(60)]
    assert sum(r["vec_id"] == 0 for r in found) == 9
    assert sorted(r["deviation"] for r in found if r["component"] == 1) == sorted(want["deviation"])
    assert np.isclose(sorted(abs(r["whitened"]) for r in found if r["component"] == 2), np.sort(np.abs(whitened[:, 1]))).all()


def test_no_rows_and_no_variance(spark):
    assert whitening.whiten(spark.createDataFrame([], KIND)).collect() == []
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    found = whitening.whiten(equal).collect()
    assert {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(0, 0.0, 0.0, 0.0)} and len(found) == 10
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    found = whitening.whiten(line).collect()
    assert {r["whitened"] for r in found if r["component"] == 2} == {0.0}
    assert max(r["identity_error"] for r in found) < 1e-9


def test_results_do_not_depend_on_partitions(spark, small_dir):
    rows = table(spark, small_dir, "embeddings")
    one, many = (sorted((r["vec_id"], r["component"], r["deviation"], round(r["whitened"], 8)) for r in whitening.whiten(rows.repartition(k)).collect()) for k in (1, 7))
    assert one == many
