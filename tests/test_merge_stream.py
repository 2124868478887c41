"""The stream of chunks against merging them all at once."""

from __future__ import annotations

import datetime
import os
import tempfile

import numpy as np
import pytest
from rubato.operators import chunks
from rubato.streaming.merge import STATE_STORE, Merger, merge_stream

KIND = "ts timestamp, recording_id long, index int, samples array<double>, fade_in int, fade_out int, parts int"
START = datetime.datetime(2026, 1, 1)


def some_parts(rng, recording: int, n: int, known: bool = True) -> list[tuple]:
    rows = []
    for i in range(n):
        samples = [float(v) for v in rng.normal(size=int(rng.integers(0, 30)))] if i % 7 else None
        rows.append((recording, i, samples, int(rng.integers(0, 6)), int(rng.integers(0, 5)), n if known else None))
    return rows


def merged(spark, rows: list[tuple]) -> dict:
    df = spark.createDataFrame([r[:5] for r in rows], "recording_id long, index int, samples array<double>, fade_in int, fade_out int")
    return {(r.recording_id, r.sample_idx): r.value for r in chunks.samples_of(chunks.merge_parts(df)).collect()}


@pytest.fixture
def state_store(spark):
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in STATE_STORE:
        spark.conf.unset(k)


def run(spark, source: str, target: str, checkpoint: str, late: str = "1 day", wait: float = 60.0) -> dict:
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
    query = merge_stream(stream, 6, late, wait).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    if not any(f.endswith(".parquet") for f in os.listdir(target)):
        return {}
    rows = chunks.samples_of(spark.read.parquet(target)).collect()
    found = {(r.recording_id, r.sample_idx): r.value for r in rows}
    assert len(found) == len(rows)  # no sample twice
    return found


def write(spark, source: str, rows: list[tuple], at: int) -> None:
    stamped = [(START + datetime.timedelta(seconds=at), *r) for r in rows]
    spark.createDataFrame(stamped, KIND).coalesce(1).write.mode("append").parquet(source)


def test_one_recording_part_by_part(spark):
    rng = np.random.default_rng(2)
    for _ in range(6):
        rows = some_parts(rng, 1, int(rng.integers(1, 12)))
        merger, found = Merger(6), {}
        for _, _, samples, a, z, _ in rows:
            for start, x in merger.add(np.array(samples or [], float), a, z):
                found.update({(1, start + i): float(v) for i, v in enumerate(x)})
        for start, x in merger.finish():
            found.update({(1, start + i): float(v) for i, v in enumerate(x)})
        assert found == pytest.approx(merged(spark, rows))
    with pytest.raises(ValueError):
        list(Merger(2).add(np.ones(5), 3, 0))


def test_shuffled_late_parts_and_a_restart(spark, state_store):
    rng = np.random.default_rng(7)
    rows = [r for k in range(3) for r in some_parts(rng, k, 9)]
    order = rng.permutation(len(rows))
    source, target, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    batches = [[rows[i] for i in part] for part in np.array_split(order, 5)]
    for at, batch in enumerate(batches[:3]):
        write(spark, source, batch, 3 - at)  # later batches carry earlier times
    before = run(spark, source, target, checkpoint)
    want = merged(spark, rows)
    assert len(before) < len(want)
    for at, batch in enumerate([*batches[3:], rows[:4]]):  # some parts come again
        write(spark, source, batch, at)
    assert run(spark, source, target, checkpoint) == pytest.approx(want)


def test_a_part_that_never_comes_is_given_up(spark, state_store):
    rng = np.random.default_rng(9)
    rows = [r for r in some_parts(rng, 1, 8, known=False) if r[1] != 3]
    source, target, checkpoint = (tempfile.mkdtemp(prefix="spark-") for _ in range(3))
    write(spark, source, rows, 0)
    other = some_parts(rng, 2, 1)
    for at in (100, 300, 600, 1000):  # the watermark goes on
        write(spark, source, other, at)
    late = [(1, 3, [9.0] * 20, 0, 0, None)]
    write(spark, source, late, 1000)
    assert run(spark, source, target, checkpoint, "1 second") == pytest.approx(merged(spark, rows + other))
