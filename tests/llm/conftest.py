"""Awkward rows that every operator on documents has to take."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, shard string, words string, _doc string, _text string, kept string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "one two", "a b a b a b a b", "été \U0001f600 中文　x", "### Assistant: </turn> \\", "x" * 5000]
    texts += [prose(rng, n) for n in (3, 60, 60, 400)]
    long_text = prose(rng, 30_000)
    texts += [long_text, long_text, long_text + " tail"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s", None, "t")[i % 3], 0) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, "no id", "en", "s", 0), (None, None, None, None, None), (None, None, None, None, None), (11, "other text of id 11", "en", "s", 1)]
    rows += [(100 + i, texts[11], "en", "hot", 0) for i in range(30)]
    return [(*r, *(["clash"] * 8)) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
