"""Streams of overlapping chunks, put together again as they come.

The state of a recording is the end of what it has so far, which the next
chunk may blend with, and the chunks that came before their turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps several variables and timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Merger:
    """The signal of one recording, part by part: ``add`` and ``finish`` give (start_sample, samples) that are final.

    Lengths follow ``chunks.fade_plan``: a part loses its last ``fade_out``
    samples and blends its first ``fade_in`` ones with the last that the part
    before has left, or fewer where either is shorter.
    """

    def __init__(self, longest_fade: int, end: int = 0, left: int = 0, tail: np.ndarray | None = None):
        self.longest_fade, self.end, self.left = longest_fade, end, left
        self.tail = np.zeros(0) if tail is None else tail

    def add(self, samples: np.ndarray, fade_in: int, fade_out: int) -> Iterator[tuple[int, np.ndarray]]:
        if fade_in > self.longest_fade:
            raise ValueError(f"a fade of {fade_in} samples is longer than {self.longest_fade}")
        n = len(samples)
        blend = min(fade_in, self.left, n)
        kept = len(self.tail) - blend
        if kept > 0:
            yield self.end - len(self.tail), self.tail[:kept]
        share = np.linspace(0, 1, blend) if blend > 1 else np.zeros(blend)
        body = samples[blend : blend + max(0, n - fade_out - blend)]
        hold = min(self.longest_fade, len(body))
        out = np.concatenate([samples[:blend] * share + self.tail[kept:] * (1 - share), body[: len(body) - hold]])
        if len(out):
            yield self.end - blend, out
        self.end, self.left, self.tail = self.end + len(body), len(body), body[len(body) - hold :]

    def finish(self) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.tail):
            yield self.end - len(self.tail), self.tail
        self.left, self.tail = 0, np.zeros(0)


class MergeParts(StatefulProcessor):
    """A ``Merger`` per recording over its stream of parts."""

    def __init__(self, longest_fade: int, wait_ms: int):
        self.longest_fade, self.wait_ms = longest_fade, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next int, end long, left long, tail array<double>")
        self.early = handle.getMapState("early", "index int", "samples array<double>, fade_in long, fade_out long, parts int")

    def _load(self) -> tuple[int, Merger]:
        if not self.at.exists():
            return 0, Merger(self.longest_fade)
        index, end, left, tail = self.at.get()
        return index, Merger(self.longest_fade, end, left, np.array(tail, float))

    def _take(self, key: tuple, merger: Merger, index: int, skip: bool = False) -> tuple[int, list]:
        """What can be given out from ``index`` on; ``skip`` goes on with the next part that is there."""
        out, ended = [], False
        if skip:
            waiting = [k for (k,) in self.early.keys()]
            index = min(waiting, default=index)
            if not waiting:
                out += merger.finish()
        while self.early.containsKey((index,)):
            samples, fade_in, fade_out, parts = self.early.getValue((index,))
            self.early.removeKey((index,))
            out += merger.add(np.array(samples, float), fade_in, fade_out)
            index += 1
            if parts is not None and index >= parts:
                out += merger.finish()
                ended = True
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended:  # only where to go on is kept, so that repeated parts stay without effect
            merger.left = 0
        self.at.update((index, int(merger.end), int(merger.left), merger.tail.tolist()))
        return index, out

    def _frame(self, key: tuple, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"recording_id": [key[0]] * len(out), "start_sample": [int(a) for a, _ in out], "samples": [x.tolist() for _, x in out]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, merger = self._load()
        latest, out = 0, []
        for frame in rows:
            latest = max(latest, int(frame["ts"].max().value // 1_000_000))
            for k, samples, fade_in, fade_out, parts in zip(frame["index"], frame["samples"], frame["fade_in"], frame["fade_out"], frame["parts"], strict=True):
                if k >= index:  # an earlier one has been merged, or given up
                    samples = [] if samples is None else [float(v) for v in samples]
                    self.early.updateValue((int(k),), (samples, int(fade_in), int(fade_out), None if pd.isna(parts) else int(parts)))
            index, found = self._take(key, merger, index)
            out += found
        if len(merger.tail) or next(iter(self.early.keys()), None) is not None:
            self.handle.registerTimer(latest + self.wait_ms)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, merger = self._load()
        index, out = self._take(key, merger, index, skip=True)
        if len(merger.tail) or next(iter(self.early.keys()), None) is not None:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.wait_ms)
        yield from self._frame(key, out)

    def close(self) -> None:
        pass


def merge_stream(parts: DataFrame, longest_fade: int, late: str = "10 minutes", wait_seconds: float = 600.0) -> DataFrame:
    """Blocks (recording_id, start_sample, samples) from a stream of (ts, recording_id, index, samples, fade_in, fade_out, parts).

    The samples are those of ``chunks.merge_parts``, in blocks as they become
    final.  Parts may come in any order; one that comes before its turn is
    kept.  No fade may be longer than ``longest_fade``, as so many samples of
    the last part are held back.  ``parts`` is how many the recording has, or
    null.  If that is unknown, or a part does not come, the watermark goes on:
    ``wait_seconds`` after a recording's last part, what was held back is given
    out, and parts that never came are left out, as ``merge_parts`` would.
    Repeated parts count once; a part that comes after its place has been given
    up is left out, as are rows later than ``late``.  A null array counts as
    empty; a null ``recording_id`` is a recording.  The session needs
    ``STATE_STORE``.
    """
    kind = parts.schema["recording_id"].dataType.simpleString()
    doubles = F.transform("samples", lambda v: v.cast("double")).alias("samples")
    own = parts.select("ts", "recording_id", F.col("index").cast("int"), doubles, F.col("fade_in").cast("long"), F.col("fade_out").cast("long"), F.col("parts").cast("int"))
    marked = own.where("ts is not null and index is not null").withWatermark("ts", late)
    return marked.groupBy("recording_id").transformWithStateInPandas(
        MergeParts(longest_fade, int(wait_seconds * 1000)), f"recording_id {kind}, start_sample long, samples array<double>", "Append", "eventTime"
    )
