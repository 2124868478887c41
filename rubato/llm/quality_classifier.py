"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Every passage is
encoded from the mean of its words' learned vectors (hashed words) and a few
character and word statistics; gated attention weighs the passages (tanh
branch times sigmoid branch, softmax over the document), and the weighted
passage representation gives the score.  All parameters are learned from
document labels alone.  Language, source and doc_id are no inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, sent_back, table

PASSAGE_WORDS = 64
BUCKETS = 1 << 12
#: Most labelled documents that the fit uses: those with the lowest hash of
#: doc_id among the rows it may learn from.  Bounds the driver's memory.
FIT_DOCUMENTS = 1500
#: Passages of one document that a fit step looks at: a long document is cut
#: into several bags with its label.  Scoring always weighs the whole document.
FIT_PASSAGES = 64
#: Bags of one document that the fit uses, evenly spaced over it; with FIT_DOCUMENTS this bounds what reaches the driver.
FIT_BAGS = 16
EPOCHS = 6
BATCH = 32
RATE = 0.01
SEED = 7
VECTOR, HIDDEN, GATE = 8, 16, 8

#: Byte classes counted per passage: spaces and others are class 0.
CLASSES = {1: b"abcdefghijklmnopqrstuvwxyz", 2: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3: b"0123456789", 4: b".,;:?\"'()-", 5: b"!", 6: b"#*$%&<>", 7: b"|"}
N_STATS = 12
_CLASS_OF = np.zeros(256, np.int64)
for _k, _chars in CLASSES.items():
    _CLASS_OF[list(_chars)] = _k
_CLASS_OF[128:] = 1


def passages(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word buckets, first word of each passage, passage statistics).

    A text without words is one passage of no words, all statistics 0.
    """
    words = (text or "").encode().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint16), np.zeros(1, np.int64), np.zeros((1, N_STATS), np.float32)
    buckets = np.fromiter(map(zlib.crc32, words), np.int64, n) & (BUCKETS - 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.arange(0, n, PASSAGE_WORDS)
    sizes = np.diff(np.r_[starts, n]).astype(np.float64)
    of_word = np.arange(n) // PASSAGE_WORDS
    raw = np.frombuffer(b"".join(words), np.uint8)
    cell = _CLASS_OF[raw] + 8 * np.repeat(of_word, lengths)
    counts = np.bincount(cell, minlength=8 * len(starts)).reshape(-1, 8)
    chars = np.maximum(counts.sum(axis=1), 1)
    same = np.r_[False, buckets[1:] == buckets[:-1]]
    order = np.sort(buckets + BUCKETS * of_word)
    fresh = np.r_[True, order[1:] != order[:-1]]
    stats = np.zeros((len(starts), N_STATS), np.float32)
    stats[:, 0] = sizes / PASSAGE_WORDS
    stats[:, 1] = np.add.reduceat(lengths, starts) / sizes / 10
    stats[:, 2] = np.add.reduceat(same.astype(np.float64), starts) / sizes
    stats[:, 3] = np.bincount(order[fresh] // BUCKETS, minlength=len(starts)) / sizes
    stats[:, 4:7] = counts[:, 1:4] / chars[:, None]
    stats[:, 7:11] = counts[:, 4:8] / sizes[:, None]
    stats[:, 11] = np.log1p(n) / 10
    return buckets.astype(np.uint16), starts, stats


@dataclass
class Model:
    """Parameters; ``prior`` replaces them when the labels hold one class at most."""

    vectors: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    prior: float | None = None


def fresh_model() -> Model:
    rng = np.random.default_rng(SEED)
    normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float64)
    return Model(
        vectors=rng.normal(size=(BUCKETS, VECTOR)) * 0.1, w=normal(VECTOR + N_STATS, HIDDEN), b=np.zeros(HIDDEN),
        v=normal(HIDDEN, GATE), u=normal(HIDDEN, GATE), a=normal(GATE), out=normal(HIDDEN), bias=np.zeros(1),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Bags:
    """Several documents' passages, laid end to end."""

    buckets: np.ndarray  # of all words
    word_starts: np.ndarray  # first word of each passage
    stats: np.ndarray
    bag_starts: np.ndarray  # first passage of each document

    @classmethod
    def of(cls, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Bags:
        words = np.cumsum([0] + [len(d[0]) for d in docs])
        bags = np.cumsum([0] + [len(d[1]) for d in docs])
        return cls(
            np.concatenate([d[0] for d in docs]).astype(np.int64),
            np.concatenate([d[1] + w for d, w in zip(docs, words[:-1], strict=True)]),
            np.concatenate([d[2] for d in docs]).astype(np.float64),
            bags[:-1],
        )


def forward(m: Model, x: Bags) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Scores of the bags and what the backward pass needs."""
    n_words = np.diff(np.r_[x.word_starts, len(x.buckets)])
    full = n_words > 0
    mean = np.zeros((len(n_words), VECTOR))
    if full.any():  # reduceat over the passages that have words
        mean[full] = np.add.reduceat(m.vectors[x.buckets], x.word_starts[full], axis=0) / n_words[full, None]
    inputs = np.concatenate([mean, x.stats], axis=1)
    h = np.tanh(inputs @ m.w + m.b)
    tv, su = np.tanh(h @ m.v), sigmoid(h @ m.u)
    gate = tv * su
    logits = gate @ m.a
    sizes = np.diff(np.r_[x.bag_starts, len(h)])
    of_bag = np.repeat(np.arange(len(sizes)), sizes)
    e = np.exp(logits - np.maximum.reduceat(logits, x.bag_starts)[of_bag])
    weights = e / np.add.reduceat(e, x.bag_starts)[of_bag]
    z = np.add.reduceat(h * weights[:, None], x.bag_starts, axis=0)
    return sigmoid(z @ m.out + m.bias[0]), {
        "inputs": inputs, "h": h, "tv": tv, "su": su, "gate": gate, "weights": weights, "z": z, "of_bag": of_bag, "n_words": n_words,
    }


def gradients(m: Model, x: Bags, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss."""
    p, c = forward(m, x)
    ds = (p - labels) / len(labels)
    h, weights, of_bag = c["h"], c["weights"], c["of_bag"]
    dz = ds[:, None] * m.out
    dzp = dz[of_bag]
    dh = dzp * weights[:, None]
    dw = (dzp * h).sum(axis=1)
    dlogit = weights * (dw - np.add.reduceat(dw * weights, x.bag_starts)[of_bag])
    dgate = dlogit[:, None] * m.a
    dtv = dgate * c["su"] * (1 - c["tv"] ** 2)
    dsu = dgate * c["tv"] * c["su"] * (1 - c["su"])
    dh += dtv @ m.v.T + dsu @ m.u.T
    dpre = dh * (1 - h**2)
    dmean = (dpre @ m.w.T)[:, :VECTOR] / np.maximum(c["n_words"], 1)[:, None]
    dvec = np.zeros_like(m.vectors)
    per_word = np.repeat(dmean, c["n_words"], axis=0)
    for j in range(VECTOR):
        dvec[:, j] = np.bincount(x.buckets, per_word[:, j], minlength=BUCKETS)
    return {
        "vectors": dvec, "w": c["inputs"].T @ dpre, "b": dpre.sum(axis=0), "v": h.T @ dtv, "u": h.T @ dsu,
        "a": c["gate"].T @ dlogit, "out": c["z"].T @ ds, "bias": np.array([ds.sum()]),
    }


def fit(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Fit by Adam; without two classes to tell apart, a constant score."""
    m = fresh_model()
    if len(set(labels)) < 2:
        m.prior = 0.5 if not labels else float(np.clip(labels[0], 0.01, 0.99))
        return m
    bags, targets = [], []
    for (words, starts, stats), y in zip(docs, labels, strict=True):
        for lo in range(0, len(starts), FIT_PASSAGES):
            hi = min(lo + FIT_PASSAGES, len(starts))
            end = starts[hi] if hi < len(starts) else len(words)
            bags.append((words[starts[lo] : end], starts[lo:hi] - starts[lo], stats[lo:hi]))
            targets.append(y)
    y = np.array(targets, np.float64)
    rng = np.random.default_rng(SEED)
    names = [f.name for f in fields(Model) if f.name != "prior"]
    first = {k: np.zeros_like(getattr(m, k)) for k in names}
    second = {k: np.zeros_like(getattr(m, k)) for k in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            grads = gradients(m, Bags.of([bags[i] for i in at]), y[at])
            step += 1
            for k in names:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.001 * (grads[k] ** 2 - second[k])
                move = RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(m, k, getattr(m, k) - move)
    return m


def score_texts(m: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of whole texts; the batch is cut where it holds many words."""
    if m.prior is not None:
        return np.full(len(texts), m.prior)
    out, held, words = [], [], 0
    for t in texts:
        held.append(passages(t))
        words += len(held[-1][0])
        if words > 1 << 17:
            out.append(forward(m, Bags.of(held))[0])
            held, words = [], 0
    if held:
        out.append(forward(m, Bags.of(held))[0])
    return np.concatenate(out) if out else np.zeros(0)


def held_out():
    """Rows that nothing is learned from: crc32 of doc_id as text, mod 3, is 1.

    A null doc_id counts as empty text, which is not held out.
    """
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def spaced(words: np.ndarray, starts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and statistics of at most ``FIT_BAGS`` bags' passages, spaced evenly over a document."""
    n_bags = -(-len(starts) // FIT_PASSAGES)
    if n_bags <= FIT_BAGS:
        return words, stats
    bags = np.linspace(0, n_bags - 2, FIT_BAGS).astype(np.int64)  # whole bags; the last one may be short
    passage = (bags[:, None] * FIT_PASSAGES + np.arange(FIT_PASSAGES)).ravel()
    return words[(passage[:, None] * PASSAGE_WORDS + np.arange(PASSAGE_WORDS)).ravel()], stats[passage]


def fit_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``FIT_DOCUMENTS`` labelled rows outside the held-out third.

    Rows of ``labels`` that contradict each other on a document are left out;
    of repeated documents one is used.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("top")).where("label = top")
    chosen = known.where(~held_out()).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [spaced(*passages(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("label"), pa.array([words.tobytes() for words, _ in rows], pa.binary()),
                    pa.array([stats.tobytes() for _, stats in rows], pa.binary()),
                ],
                ["doc_id", "label", "words", "stats"],
            )

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"doc_id {kind}, label int, words binary, stats binary").dropDuplicates(["doc_id"]).collect()
    bags, targets = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        words = np.frombuffer(r["words"], np.uint16)
        starts = np.arange(0, max(1, len(words)), PASSAGE_WORDS)
        bags.append((words, starts, np.frombuffer(r["stats"], np.float32).reshape(-1, N_STATS)))
        targets.append(r["label"])
    return fit(bags, targets)


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: tuple[str, ...] = ("text",)) -> DataFrame:
    """The columns ``keep`` and the score of every whole text, which ``text`` names, within a struct too.

    Null and empty texts score as one passage without words.  Repeated rows
    score alike; other columns are ignored; an empty input gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts(model, column_of(batch, text).to_pylist())
            yield from sent_back(pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(scores, pa.float64())], [*keep, "score"]))

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*dict.fromkeys([*keep, text[0]])).mapInArrow(run, f"{schema}, score double")


def accepted_documents(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``least`` or more."""
    packed = docs.select(F.struct("*").alias("_doc"))
    return score_documents(packed, model, ("_doc",), ("_doc", "text")).where(F.col("score") >= least).select("_doc.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
