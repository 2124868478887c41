"""Queries of the library's own operators, and their SQL.

The test tables hold no audio, so ``events`` stands in for one-dimensional
series (a recording per user), ``embeddings`` for spectra (a recording per
label) and text tables for labels and lengths.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as s
from .operators import chunks, evaluation, frame_blocks, importance, joins, rates, recurrences, schedules, signal, signal_blocks, stretch
from .operators import windows as w
from .plans.analysis import accelerate, analyse, held_up, scored_events
from .scratch import dealt, written
from .sources import audio
from .sources.audio import analysis_documents
from .streaming.tumbling import tumbling_energy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frames of events, with scores, as SQL.
FRAMES = """frames AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, value, event_type
  FROM events
)"""
SCORED = FRAMES + """, scored AS (
  SELECT *, CASE WHEN max(value) OVER r > min(value) OVER r THEN (value - min(value) OVER r) / (max(value) OVER r - min(value) OVER r) ELSE 0 END AS score
  FROM frames WINDOW r AS (PARTITION BY recording_id)
)"""
MEL = """mel AS (
  SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding::DOUBLE[] AS mel FROM embeddings
)"""
ORDERED = "(PARTITION BY recording_id ORDER BY frame_idx)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.frames_from_events(read(spark, sf_dir, "events"))


def mel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("label").orderBy("vec_id")
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording_id"), (F.row_number().over(order) - 1).alias("frame_idx"), F.transform("embedding", lambda v: v.cast("double")).alias("mel")
    )


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


def _smooth_sql(x: str, sigma: float) -> str:
    """Gaussian filter of a list ``x`` of ``n`` values, edges reflected with repeat."""
    r = int(4 * sigma + 0.5)
    w = f"list_transform(range({-r}, {r + 1}), lambda d: exp(-(d * d) / {2 * sigma * sigma}))"
    at = lambda j: f"CASE WHEN (({j}) % (2 * n) + 2 * n) % (2 * n) < n THEN (({j}) % (2 * n) + 2 * n) % (2 * n) ELSE 2 * n - 1 - (({j}) % (2 * n) + 2 * n) % (2 * n) END"
    return f"list_transform(range(0, n), lambda i: list_sum(list_transform(range({-r}, {r + 1}), lambda d: exp(-(d * d) / {2 * sigma * sigma}) * {x}[{at('i + d')} + 1])) / list_sum({w}))"


def _meet_sql(name: str, source: str, rounds: int, tolerance: float) -> str:
    """CTEs that scale and clip rates until they meet the goal; ``name`` has the last state."""
    total = "list_sum(list_transform(range(1, n + 1), lambda i: dt[i] / r[i]))"
    return f"""{name}_steps AS (SELECT recording_id, n, t, dt, goal, r, 0 AS k, {total} AS got FROM {source}
    UNION ALL SELECT recording_id, n, t, dt, goal, r, k, {total} FROM (SELECT recording_id, n, t, dt, goal, k + 1 AS k, list_transform(r, lambda x: least(greatest(x * got / goal, 1), 10)) AS r
      FROM {name}_steps WHERE k < {rounds} AND abs(got - goal) / goal >= {tolerance})),
  {name} AS (SELECT recording_id, any_value(n) AS n, any_value(t) AS t, any_value(dt) AS dt, any_value(goal) AS goal, arg_max(r, k) AS r FROM {name}_steps GROUP BY 1)"""


@query(f"""WITH RECURSIVE {SCORED}, lists AS (SELECT recording_id, count(*)::INT AS n, list(score ORDER BY frame_idx) AS s, list(t ORDER BY frame_idx) AS t FROM scored GROUP BY 1),
  smooth AS (SELECT recording_id, n, t, list_transform({_smooth_sql("s", 15.0)}, lambda v: 1 + 9 * (1 - least(greatest(v, 0), 1))) AS raw, t[n] / 3.0 AS goal,
    list_transform(range(1, n + 1), lambda i: t[i] - CASE WHEN i = 1 THEN 0 ELSE t[i - 1] END) AS dt FROM lists),
  scaled AS (SELECT recording_id, n, t, dt, goal, list_transform(raw, lambda x: least(greatest(x * (list_sum(list_transform(range(1, n + 1), lambda i: dt[i] / raw[i])) / goal), 1), 10)) AS r FROM smooth),
  {_meet_sql("met", "scaled", 20, 0.001)},
  curved AS (SELECT * REPLACE (list_transform(r, lambda x: least(greatest(1 + pow((x - 1) / 9, 1.5) * 9, 1), 10)) AS r) FROM met),
  {_meet_sql("bent", "curved", 10, 0.001)},
  slewed AS (SELECT * REPLACE (list_transform(range(1, n + 1), lambda i: list_min(list_transform(range(1, i + 1), lambda j: r[j] - 0.3 * (j - 1))) + 0.3 * (i - 1)) AS r) FROM bent),
  eased AS (SELECT * REPLACE (CASE WHEN n > 4 THEN list_transform({_smooth_sql("r", 2.0)}, lambda x: least(greatest(x, 1), 10)) ELSE r END AS r) FROM slewed),
  {_meet_sql("final", "eased", 10, 0.002)}
  SELECT recording_id, (i - 1)::INT AS frame_idx, t[i] AS t, round(r[i], 5) AS rate FROM final, LATERAL (SELECT unnest(range(1, n + 1)) AS i)""")
def rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scores to the rate of every frame, such that recordings meet their target durations."""
    out = schedules.schedule_long(scored_events(read(spark, sf_dir, "events")), 3.0)
    return out.select("recording_id", "frame_idx", "t", F.round("rate", 5).alias("rate"))


@query(f"""WITH {SCORED} SELECT recording_id, frame_idx::INT AS frame_idx, t, round(score, 6) AS score,
  round(1 + (1 - score) * 9, 6) AS rate, round(least(greatest(1 + pow((1 - score), 1.5) * 9, 1), 10), 6) AS contrasted FROM scored""")
def importance_to_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = s.importance_to_rate(F.col("score"))
    return scored_events(read(spark, sf_dir, "events")).select(
        "recording_id", "frame_idx", "t", r6("score", "score"), r6(rate, "rate"), r6(s.rate_contrast(rate, 1.5), "contrasted")
    )


@query(f"""WITH {FRAMES} SELECT recording_id, frame_idx::INT AS frame_idx,
  max(value) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS highest,
  round(min(value - frame_idx * 0.3) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + frame_idx * 0.3, 6) AS limited,
  round(CASE WHEN lag(value) OVER o IS NULL THEN lead(value) OVER o - value WHEN lead(value) OVER o IS NULL THEN value - lag(value) OVER o
        ELSE (lead(value) OVER o - lag(value) OVER o) / 2 END, 6) AS slope
  FROM frames WINDOW o AS {ORDERED}""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    near = frame_blocks.near_windows(frames(spark, sf_dir), 3, {"highest": lambda o: w.max_filter(v, own=o), "slope": lambda o: w.gradient(v, own=o)})
    return frame_blocks.slew_limited(near, "value").select("recording_id", "frame_idx", "highest", r6("limited", "limited"), r6("slope", "slope"))


@query(f"""WITH {FRAMES}, m AS (
  SELECT *, median(value) OVER f AS med, count(*) OVER f AS n FROM frames
  WINDOW f AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
  SELECT recording_id, frame_idx::INT AS frame_idx, round(CASE WHEN n = 21 THEN med END, 6) AS median,
         coalesce(n = 21 AND med > 1e-10 AND value > 5 * med, false) AS click FROM m""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return frames(spark, sf_dir).select("recording_id", "frame_idx", r6(w.running_median(v), "median"), w.is_click(v).alias("click"))


@query(f"""WITH {FRAMES} SELECT recording_id, (frame_idx // 8)::INT AS frame_idx, round(sum(value * value), 4) AS power, round(sqrt(avg(value * value)), 6) AS rms
  FROM frames GROUP BY ALL HAVING count(*) = 8""")
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.frame_energy(frames(spark, sf_dir), 8).select("recording_id", "frame_idx", F.round(F.col("energy") * 8, 4).alias("power"), r6("rms", "rms"))


@query(f"""WITH {FRAMES}, sized AS (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
  k AS (SELECT d, exp(-(d * d) / 8.0) / (SELECT sum(exp(-(e * e) / 8.0)) FROM range(-8, 9) x(e)) AS w FROM range(-8, 9) y(d)),
  wanted AS (SELECT recording_id, frame_idx, n, w, ((frame_idx + d) % (2 * n) + 2 * n) % (2 * n) AS m FROM sized, k)
  SELECT a.recording_id, a.frame_idx::INT AS frame_idx, round(sum(w * b.value), 6) AS smoothed
  FROM wanted a JOIN frames b ON a.recording_id = b.recording_id AND b.frame_idx = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL""")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.gaussian_smooth(frames(spark, sf_dir), 2.0).select("recording_id", "frame_idx", r6("smoothed", "smoothed"))


@query(f"""WITH {SCORED}, stepped AS (
  SELECT *, (t - coalesce(lag(t) OVER {ORDERED}, 0)) / (1 + (1 - score) * 9) AS step FROM scored)
  SELECT recording_id, frame_idx::INT AS frame_idx, round(sum(step) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS out_time FROM stepped""")
def output_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda o: w.step_in(F.col("t"), own=o) / s.importance_to_rate(F.col("score"))
    rows = frame_blocks.near_windows(scored_events(read(spark, sf_dir, "events")), 1, {"step": step})
    found = frame_blocks.scanned(rows, {"out_time": frame_blocks.Scan("sum", F.col("step"))})
    return found.select("recording_id", "frame_idx", F.round("out_time", 4).alias("out_time"))


@query(f"""WITH {FRAMES}, q AS (SELECT recording_id, i::INT AS frame_idx, i * d / 63 AS t FROM (SELECT recording_id, max(t) AS d FROM frames GROUP BY 1), range(64) r(i)),
  b AS (SELECT q.*, f.t AS t0, f.value AS v0 FROM q ASOF JOIN frames f ON q.recording_id = f.recording_id AND q.t >= f.t),
  a AS (SELECT b.*, f.t AS t1, f.value AS v1 FROM b ASOF LEFT JOIN frames f ON b.recording_id = f.recording_id AND b.t <= f.t)
  SELECT recording_id, frame_idx, round(t, 4) AS t, round(CASE WHEN t1 IS NULL OR t1 <= t0 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 4) AS value FROM a""")
def asof_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = frames(spark, sf_dir)
    grid = joins.time_grid(knots.groupBy("recording_id").agg(F.max("t").alias("duration")), F.lit(64))
    found = frame_blocks.interpolated(knots, grid, 86_400.0)
    return found.select("recording_id", "frame_idx", F.round("t", 4).alias("t"), F.round("value", 4).alias("value"))


@query(f"""WITH {SCORED}, d AS (SELECT recording_id, max(t) AS d, greatest(1, floor(max(t) / 3600.0))::INT AS n FROM scored GROUP BY 1),
  q AS (SELECT recording_id, i::INT AS frame_idx, CASE WHEN n > 1 THEN i * d / (n - 1) ELSE 0 END AS t FROM d, LATERAL (SELECT unnest(range(n)) AS i)),
  b AS (SELECT q.*, f.t AS t0, f.score AS v0 FROM q ASOF JOIN scored f ON q.recording_id = f.recording_id AND q.t >= f.t),
  a AS (SELECT b.*, f.t AS t1, f.score AS v1 FROM b ASOF LEFT JOIN scored f ON b.recording_id = f.recording_id AND b.t <= f.t)
  SELECT recording_id, frame_idx, round(t, 4) AS t, round(CASE WHEN t1 IS NULL OR t1 <= t0 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS score FROM a""")
def resample_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.resample_importance(scored_events(read(spark, sf_dir, "events")).withColumnRenamed("value", "raw").withColumnRenamed("score", "value"), 3600.0)
    return found.select("recording_id", "frame_idx", F.round("t", 4).alias("t"), r6("value", "score"))


@query(f"""WITH {MEL}, want AS (SELECT recording_id, i::INT AS frame_idx, i * 1.5 AS src FROM (SELECT recording_id, count(*) AS n FROM mel GROUP BY 1), range(1000000) r(i) WHERE i * 1.5 <= n - 1)
  SELECT w.recording_id, w.frame_idx, k::INT AS bin, round(a.mel[k + 1] + (coalesce(b.mel[k + 1], a.mel[k + 1]) - a.mel[k + 1]) * (src - floor(src)), 6) AS value
  FROM want w JOIN mel a ON a.recording_id = w.recording_id AND a.frame_idx = floor(src) LEFT JOIN mel b ON b.recording_id = w.recording_id AND b.frame_idx = floor(src) + 1, range(64) x(k)""")
def index_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    mel = mel_frames(spark, sf_dir)
    sized = mel.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    want = sized.select("recording_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1.5).cast("int"))).alias("frame_idx"))
    want = want.withColumn("src", F.col("frame_idx") * 1.5)
    found = joins.index_interpolate(mel, want).select("recording_id", "frame_idx", F.posexplode("mel").alias("bin", "value"))
    return found.withColumn("value", F.round("value", 6))


_CLASS_SQL = "CASE " + " ".join(f"WHEN contains('{labels.replace(chr(39), '')}', label) THEN '{name}'" for name, labels in s.CLASS_LABELS.items()) + " ELSE 'plosive' END"
_FLOOR_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{n}' THEN {f}::DOUBLE" for n, f in s.CLASS_FLOORS.items()) + " END"


@query(f"""WITH segs AS (SELECT label AS recording_id, vec_id AS seq, chr((97 + (vec_id % 26))::INT) AS label, (vec_id % 37) / 4.0 AS s, (vec_id % 37) / 4.0 + (vec_id % 5) / 8.0 AS e FROM embeddings),
  grid AS (SELECT r.recording_id, i::INT AS frame_idx FROM (SELECT DISTINCT recording_id FROM segs) r, range(500) x(i)),
  hit AS (SELECT g.recording_id, g.frame_idx, max_by(label, seq) AS label FROM grid g JOIN segs ON g.recording_id = segs.recording_id AND frame_idx >= floor(s * 50) AND frame_idx < least(floor(e * 50), 500) GROUP BY 1, 2)
  SELECT g.recording_id, g.frame_idx, h.label, CASE WHEN h.label IS NULL THEN 0.02::DOUBLE ELSE {_FLOOR_SQL("(" + _CLASS_SQL.replace("label)", "h.label)") + ")")} END AS floor FROM grid g LEFT JOIN hit h USING (recording_id, frame_idx)""")
def interval_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("vec_id") % 37 / 4.0
    segments = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("recording_id"), F.col("vec_id").alias("seq"), F.char(97 + F.col("vec_id") % 26).alias("label"), start.alias("start"), (start + F.col("vec_id") % 5 / 8.0).alias("end")
    )
    durations = segments.select("recording_id", F.lit(10.0).alias("duration")).distinct()
    return joins.interval_floors(segments, durations)


@query(f"""WITH {MEL}, lp AS (SELECT recording_id, frame_idx, list_transform(mel[1:29], lambda v: v * 8 - ln(list_sum(list_transform(mel[1:29], lambda u: exp(u * 8))))) AS lp FROM mel),
  best AS (SELECT recording_id, frame_idx, lp, substr('aienuotsrmkldghybpwcvjzf''qx*', list_position(lp[2:29], list_max(lp[2:29])), 1) AS label, count(*) OVER (PARTITION BY recording_id) AS n FROM lp),
  cls AS (SELECT *, CASE WHEN exp(lp[1]) > 0.8 THEN 'silence' ELSE {_CLASS_SQL} END AS class FROM best)
  SELECT recording_id, frame_idx::INT AS frame_idx, round(frame_idx * 10.0 / (n - 1), 6)::DOUBLE AS t, class, {_FLOOR_SQL("class")} AS floor FROM cls""")
def phoneme_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("mel", 1, 29), lambda v: v * 8)
    norm = F.log(s.total(F.transform(logits, F.exp)))
    emissions = mel_frames(spark, sf_dir).select("recording_id", "frame_idx", F.transform(logits, lambda v: v - norm).alias("log_probs"))
    durations = emissions.select("recording_id", F.lit(10.0).alias("duration")).distinct()
    return importance.phoneme_floors(emissions, durations).withColumn("t", F.round("t", 6))


#: The blend of the spectral importance, before it is scaled, as SQL.
_MEL_SCORES = f"""f AS (SELECT recording_id, frame_idx, mel, lag(mel) OVER {ORDERED} AS prev FROM mel),
  a AS (SELECT recording_id, frame_idx, list_sum(mel) AS e, list_sum(mel[39:64]) AS h,
        CASE WHEN prev IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(range(1, 65), lambda i: pow((mel[i] - prev[i]) * CASE WHEN i > 32 THEN 2.5 ELSE 1 END, 2)))) END AS flux FROM f),
  b AS (SELECT recording_id, frame_idx, flux / max(flux) OVER r AS flux, (e - min(e) OVER r) / (max(e) OVER r - min(e) OVER r) AS e, (h - min(h) OVER r) / (max(h) OVER r - min(h) OVER r) AS h FROM a WINDOW r AS (PARTITION BY recording_id)),
  c AS (SELECT *, max(flux) OVER w AS peak FROM b WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  d AS (SELECT *, CASE WHEN e < 0.05 AND max(peak) OVER w > 0.3 THEN 1 ELSE 0 END AS closed FROM c WINDOW w AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  x AS (SELECT *, (0.5 * peak + 0.25 * e + 0.15 * h + 0.1 * closed)::DOUBLE AS blend FROM d)"""


@query(f"""WITH {MEL}, {_MEL_SCORES}
  SELECT recording_id, frame_idx::INT AS frame_idx, round((blend - min(blend) OVER r) / (max(blend) OVER r - min(blend) OVER r), 6) AS score FROM x WINDOW r AS (PARTITION BY recording_id)""")
def mel_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.mel_importance(mel_frames(spark, sf_dir)).select("recording_id", "frame_idx", r6("score", "score"))


_CODES = [(k, 3 + k) for k in range(8)]


@query(f"""WITH {FRAMES}, c AS (SELECT recording_id, frame_idx, value, [{", ".join(f"floor(value / {5 + k})::INT % {m}" for k, m in _CODES)}] AS cb FROM frames),
  p AS (SELECT *, lag(cb) OVER {ORDERED} AS prev, max(value) OVER (PARTITION BY recording_id) AS top FROM c),
  x AS (SELECT recording_id, frame_idx, (0.45 * CASE WHEN prev IS NULL OR cb[1] = prev[1] THEN 0 ELSE 1 END + 0.15 * CASE WHEN value / top > 0.05 THEN 1 ELSE 0 END
        + 0.40 * CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, 9), lambda i: cb[i] <> prev[i])) / 8.0 END)::DOUBLE AS b FROM p)
  SELECT recording_id, frame_idx::INT AS frame_idx, round((b - min(b) OVER r) / (max(b) OVER r - min(b) OVER r), 6) AS score FROM x WINDOW r AS (PARTITION BY recording_id)""")
def codec_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda k, m: F.floor(F.col("value") / (5 + k)).cast("int") % m
    codes = frames(spark, sf_dir).withColumn("cb", F.array(*[code(k, m) for k, m in _CODES])).withColumn("rms", F.col("value"))
    return importance.codec_importance(codes).select("recording_id", "frame_idx", r6("score", "score"))


@query("""WITH c AS (SELECT doc_id AS recording_id, n_chars AS n, i AS index, i * 1000 AS pos FROM documents, LATERAL (SELECT unnest(range(CASE WHEN n_chars <= 1000 THEN 1 ELSE (n_chars + 999) // 1000 END)) AS i))
  SELECT recording_id, index::INT AS index, greatest(0, pos - 100) AS start_sample, least(pos + 1100, n) AS end_sample, pos - greatest(0, pos - 100) AS overlap_before,
         CASE WHEN pos + 1000 < n THEN greatest(0, least(pos + 1100, n) - pos - 1000) ELSE 0 END AS overlap_after FROM c""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("recording_id"), F.col("n_chars").alias("n_samples"))
    return chunks.plan_chunks(sizes, 1000, 100)


@query(f"""WITH {SCORED}, c AS (SELECT recording_id, i AS index, greatest(0, i * 86400 - 7200) AS a, least(i * 86400 + 93600, ceil(d)) AS b
    FROM (SELECT recording_id, max(t) AS d FROM frames GROUP BY 1), LATERAL (SELECT unnest(range(greatest(1, ceil(ceil(d) / 86400)::INT))) AS i))
  SELECT c.recording_id, index::INT AS index, round(t - a, 6) AS t, round(1 + (1 - score) * 9, 6) AS rate FROM c JOIN scored s ON s.recording_id = c.recording_id AND t BETWEEN a AND b""")
def chunk_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rates(spark, sf_dir, chunks.points_in_chunks)


@query(f"""WITH {SCORED}, c AS (SELECT recording_id, i AS index, greatest(0, i * 86400 - 7200) AS a, least(i * 86400 + 93600, ceil(d)) AS b
    FROM (SELECT recording_id, max(t) AS d FROM frames GROUP BY 1), LATERAL (SELECT unnest(range(greatest(1, ceil(ceil(d) / 86400)::INT))) AS i)),
  r AS (SELECT recording_id, t, 1 + (1 - score) * 9 AS rate FROM scored),
  k AS (SELECT c.recording_id, index, a, b, (a + b) / 2 AS m, count(*) FILTER (t BETWEEN a AND b) AS n, sum(rate) FILTER (t BETWEEN a AND b) AS s, min(t - a) FILTER (t BETWEEN a AND b) AS f,
      max(t) FILTER (t <= (a + b) / 2) AS t0, max_by(rate, {{'t': t, 'r': rate}}) FILTER (t <= (a + b) / 2) AS r0,
      min(t) FILTER (t > (a + b) / 2) AS t1, min_by(rate, {{'t': t, 'r': rate}}) FILTER (t > (a + b) / 2) AS r1
    FROM c JOIN r ON r.recording_id = c.recording_id GROUP BY ALL)
  SELECT k.recording_id, index::INT AS index, round(t - a, 6) AS t, round(rate, 6) AS rate FROM k JOIN r ON r.recording_id = k.recording_id AND t BETWEEN a AND b
  UNION ALL SELECT recording_id, index::INT, round(t, 6), round(CASE WHEN t0 IS NULL THEN r1 WHEN t1 IS NULL THEN r0 ELSE r0 + (r1 - r0) * (m - t0) / (t1 - t0) END, 6)
    FROM k, LATERAL (SELECT unnest([0, b - a]) AS t) WHERE n = 0""")
def chunk_rates_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_rates(spark, sf_dir, chunks.rates_in_chunks)


def _chunk_rates(spark: SparkSession, sf_dir: str, within) -> DataFrame:
    scored = scored_events(read(spark, sf_dir, "events"))
    sizes = scored.groupBy("recording_id").agg(F.ceil(F.max("t")).alias("n_samples"))
    found = within(chunks.plan_chunks(sizes, 86_400, 7_200), scored.withColumn("rate", s.importance_to_rate(F.col("score"))), 1.0, 86_400)
    return found.select("recording_id", "index", r6("t", "t"), r6("rate", "rate"))


_HANN64 = [0.5 - 0.5 * math.cos(2 * math.pi * i / 64) for i in range(64)]


@query(f"""WITH {MEL}, p AS (SELECT recording_id, frame_idx * 32 + i AS sample_idx, mel[i + 1] AS v, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS w FROM mel, range(64) r(i))
  SELECT recording_id, sample_idx::INT AS sample_idx, round(sum(v * w) / greatest(sum(w * w), 1e-8), 6) AS value FROM p GROUP BY 1, 2""")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = mel_frames(spark, sf_dir).withColumnRenamed("mel", "samples")
    return chunks.overlap_add(parts, 32, F.array(*[F.lit(x) for x in _HANN64])).select("recording_id", F.col("sample_idx").cast("int"), r6("value", "value"))


@query(f"""WITH {MEL}, p AS (SELECT recording_id, frame_idx * 56 + i AS sample_idx, mel[i + 1]
    * CASE WHEN i < 8 AND frame_idx > 0 THEN i / 7.0 ELSE 1 END * CASE WHEN i >= 56 THEN 1 - (i - 56) / 7.0 ELSE 1 END AS v FROM mel, range(64) r(i))
  SELECT recording_id, sample_idx::INT AS sample_idx, round(sum(v), 6) AS value FROM p GROUP BY 1, 2""")
def crossfade_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fade = F.when(F.col("frame_idx") > 0, 8).otherwise(0)
    parts = mel_frames(spark, sf_dir).select("recording_id", F.col("frame_idx").alias("index"), F.col("mel").alias("samples"), fade.alias("fade_in"), F.lit(8).alias("fade_out"))
    return chunks.crossfade_concat(parts).select("recording_id", F.col("sample_idx").cast("int"), r6("value", "value"))


@query(f"""WITH {MEL}, q AS (SELECT *, frame_idx % 7 AS ratio FROM mel), x AS (SELECT *, (ratio - min(ratio) OVER r) / (max(ratio) OVER r - min(ratio) OVER r)::DOUBLE AS k FROM q WINDOW r AS (PARTITION BY recording_id)),
  e AS (SELECT recording_id, frame_idx, i, mel[i + 1] - CASE WHEN i >= 25 THEN (1 + 5 * k) * pow((i - 25) / 38.0, 1.5) ELSE 0 END AS v FROM x, range(64) b(i))
  SELECT recording_id, frame_idx::INT AS frame_idx, i::INT AS bin, round(v, 6) AS value FROM e""")
def hf_deemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mel_frames(spark, sf_dir).withColumn("ratio", (F.col("frame_idx") % 7).cast("double"))
    out = importance.hf_deemphasis(rows)
    return out.select("recording_id", "frame_idx", F.posexplode("mel").alias("bin", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {FRAMES}, a AS (SELECT recording_id, frame_idx, value / 400 - 0.6 AS x FROM frames), p AS (SELECT *, max(abs(x)) OVER r AS peak FROM a WINDOW r AS (PARTITION BY recording_id)),
  c AS (SELECT *, CASE WHEN peak > 0.8 AND abs(x) > 0.8 THEN sign(x) * (0.8 + tanh((abs(x) - 0.8) / (peak - 0.8 + 1e-10)) * 0.2) ELSE x END AS y FROM p),
  q AS (SELECT *, y * (0.2 / sqrt(avg(y * y) OVER (PARTITION BY recording_id))) AS z FROM c)
  SELECT recording_id, frame_idx::INT AS frame_idx, round(CASE WHEN max(abs(z)) OVER r > 0.99 THEN z * (0.99 / max(abs(z)) OVER r) ELSE z END, 6) AS out FROM q WINDOW r AS (PARTITION BY recording_id)""")
def soft_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("value", F.col("value") / 400 - 0.6)
    return w.soft_clip(rows, 0.2).select("recording_id", "frame_idx", r6("out", "out"))


@query(f"""WITH {FRAMES}, m AS (SELECT *, median(value) OVER f AS med, count(*) OVER f AS n FROM frames WINDOW f AS (PARTITION BY recording_id ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))
  SELECT recording_id, count(*) FILTER (n = 25 AND med > 1e-10 AND value > 3 * med) AS n_clicks,
         round(CASE WHEN count(*) * 0.002 < 0.01 THEN 0 ELSE count(*) FILTER (n = 25 AND med > 1e-10 AND value > 3 * med) / (count(*) * 0.002) END, 4)::DOUBLE AS clicks_per_second FROM m GROUP BY 1""")
def click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.click_counts(frames(spark, sf_dir).withColumnRenamed("value", "energy")).withColumn("clicks_per_second", F.round("clicks_per_second", 4))


#: Edit distance of two lists with at most 125 values in common: each of these becomes an ASCII character, the others one a side.
_DISTANCE_SQL = """levenshtein(coalesce(list_aggregate(list_transform(r, lambda x: chr(coalesce(list_position(common, x) + 2, 1)::INT)), 'string_agg', ''), ''),
    coalesce(list_aggregate(list_transform(h, lambda x: chr(coalesce(list_position(common, x) + 2, 2)::INT)), 'string_agg', ''), ''))"""


@query(f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  w AS (SELECT conv_id, turn, string_split(text, '') AS h, string_split(before, '') AS r FROM p WHERE length(before) > 0), x AS (SELECT *, list_sort(list_intersect(r, h)) AS common FROM w)
  SELECT conv_id, turn, round({_DISTANCE_SQL} / len(r)::DOUBLE, 6) AS cer FROM x""")
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("h"), before.alias("r"))
    return rows.where("length(r) > 0").select("conv_id", "turn", r6(evaluation.character_error_rate(F.col("r"), F.col("h")), "cer"))


@query(f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
  w AS (SELECT conv_id || '-' || turn AS pair_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS h, regexp_extract_all(before, '[^ \\t\\n\\x0B\\f\\r]+') AS r FROM p WHERE before IS NOT NULL),
  x AS (SELECT *, list_sort(list_intersect(r, h)) AS common FROM w)
  SELECT pair_id, CASE WHEN len(r) > 0 THEN round({_DISTANCE_SQL} / len(r)::DOUBLE, 6) END AS wer FROM x""")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("text").alias("hypothesis"), before.alias("reference"))
    return evaluation.word_error_rates(pairs.where("reference is not null")).withColumn("wer", F.round("wer", 6))


@query("""SELECT lang AS session, avg((quality = 1 - toxic)::INT::DOUBLE) AS accuracy, count(*) AS n,
  CASE WHEN avg((quality = 1 - toxic)::INT::DOUBLE) >= 0.7 THEN 'audible' WHEN avg((quality = 1 - toxic)::INT::DOUBLE) >= 0.55 THEN 'marginal' ELSE 'inaudible' END AS verdict
  FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def listening_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    trials = read(spark, sf_dir, "labels").join(langs, "doc_id").select(F.col("lang").alias("session"), (F.col("quality") == 1 - F.col("toxic")).alias("correct"))
    return evaluation.listening_verdicts(trials)


@query("""WITH b AS (SELECT label AS batch, i AS bin, row_number() OVER (PARTITION BY label, i ORDER BY vec_id) AS f, embedding[i + 1]::DOUBLE AS phase, abs(embedding[i + 1]::DOUBLE) AS mag FROM embeddings, range(64) r(i)),
  d AS (SELECT batch, bin, lead(phase) OVER o - phase - bin * (2 * pi() * 256 / 1024) AS d, lead(mag) OVER o AS m, max(mag) OVER (PARTITION BY batch) AS top FROM b WINDOW o AS (PARTITION BY batch, bin ORDER BY f))
  SELECT batch, round(avg(m / top * pow(atan2(sin(d), cos(d)), 2)), 6) AS loss FROM d WHERE d IS NOT NULL AND bin >= 1 GROUP BY 1""")
def frequency_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = mel_frames(spark, sf_dir).select(F.col("recording_id").alias("batch"), "frame_idx", F.posexplode("mel").alias("bin", "phase")).withColumn("mag", F.abs("phase"))
    return evaluation.frequency_deviation(bins).withColumn("loss", F.round("loss", 6))


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) <= 100 AS is_validation FROM documents""")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.validation_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("""WITH st AS (SELECT lang || '_' || source || '_' || (doc_id % 2)::VARCHAR AS key, doc_id, lang || '_' || source || '_' || (doc_id % 2)::VARCHAR || '_' || doc_id::VARCHAR AS stem FROM documents)
  SELECT l.key, l.stem AS left_stem, r.right_stem FROM (SELECT * FROM st WHERE doc_id % 3 = 0) l JOIN (SELECT key, min(stem) AS right_stem FROM st WHERE doc_id % 3 = 1 GROUP BY 1) r USING (key)""")
def matching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File stems of two folders, here documents by doc_id modulo 3, matched by their first parts."""
    stems = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("_", "lang", "source", F.col("doc_id") % 2, "doc_id").alias("stem"))
    return joins.first_matches(stems.where("doc_id % 3 = 0"), stems.where("doc_id % 3 = 1"))


@query("""WITH a AS (SELECT DISTINCT (2 + quality)::VARCHAR || '.0' AS speed FROM labels WHERE quality IS NOT NULL), b AS (SELECT DISTINCT CASE WHEN toxic = 1 THEN '1.5' ELSE '1.0' END AS gamma FROM labels),
  c AS (SELECT DISTINCT (turn * 700)::INT AS step FROM conversations), d AS (SELECT DISTINCT CASE label % 3 WHEN 0 THEN '20ms' WHEN 1 THEN '1s' ELSE ' 50 ' END AS res FROM embeddings)
  SELECT speed, gamma, speed || 'x-' || gamma AS name, step, CASE WHEN step < 1000 THEN 0.15 WHEN step < 3000 THEN 0.15 + (step - 1000) / 2000.0 * 0.10 ELSE 0.25 END::DOUBLE AS ratio,
  res, CASE res WHEN '20ms' THEN 0.02 WHEN '1s' THEN 1.0 ELSE 0.05 END::DOUBLE AS seconds FROM a, b, c, d""")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the settings that occur in the tables, a few of each kind."""
    labels, label = read(spark, sf_dir, "labels"), F.col("label") % 3
    speed = labels.where("quality is not null").select(F.concat((F.col("quality") + 2).cast("int").cast("string"), F.lit(".0")).alias("speed")).distinct()
    gamma = labels.select(F.when(F.col("toxic") == 1, "1.5").otherwise("1.0").alias("gamma")).distinct()
    step = read(spark, sf_dir, "conversations").select((F.col("turn") * 700).cast("int").alias("step")).distinct()
    res = read(spark, sf_dir, "embeddings").select(F.when(label == 0, "20ms").when(label == 1, "1s").otherwise(" 50 ").alias("res")).distinct()
    grid = joins.config_grid(speed, gamma, step, res)
    return grid.select("speed", "gamma", F.concat("speed", F.lit("x-"), "gamma").alias("name"), "step", s.augmentation_ratio(F.col("step")).alias("ratio"), "res", s.parse_resolution(F.col("res")).alias("seconds"))


@query("""SELECT start, user_id AS recording_id, round(sum(value * value), 4) AS power, count(*) AS n
  FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' FOR k IN range(4)]) AS start) GROUP BY 1, 2""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("recording_id"), "value")
    return tumbling_energy(rows, "1 hour", slide="15 minutes").select("start", "recording_id", F.round(F.col("energy") * F.col("n"), 4).alias("power"), "n")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS start, user_id AS recording_id, round(sum(value * value), 4) AS power, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("ts", F.col("user_id").alias("recording_id"), "value")
    return tumbling_energy(rows, "1 hour").select("start", "recording_id", F.round(F.col("energy") * F.col("n"), 4).alias("power"), "n")


@query(f"""WITH {MEL}, {_MEL_SCORES}, s AS (SELECT recording_id, frame_idx, (blend - min(blend) OVER r) / (max(blend) OVER r - min(blend) OVER r) AS v,
    frame_idx * 10.0 / (count(*) OVER r - 1) AS t FROM x WINDOW r AS (PARTITION BY recording_id)),
  q AS (SELECT DISTINCT recording_id, i::INT AS i, i * 10.0 / 39 AS t FROM s, range(40) g(i)),
  l AS (SELECT q.*, s.t AS t0, s.v AS v0 FROM q ASOF JOIN s ON q.recording_id = s.recording_id AND q.t >= s.t - 1e-12),
  m AS (SELECT l.*, s.t AS t1, s.v AS v1 FROM l ASOF LEFT JOIN s ON l.recording_id = s.recording_id AND l.t <= s.t + 1e-12)
  SELECT recording_id, 40 AS n_frames, 10.0::DOUBLE AS duration, 4.0::DOUBLE AS frame_rate, i, round(t, 6)::DOUBLE AS t,
    round(CASE WHEN t1 IS NULL OR t1 <= t0 THEN v0 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 5) AS score FROM m""")
def analysis_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents of an analysis, read back to rows."""
    documents = analysis_documents(analyse(mel_frames(spark, sf_dir), 10.0, 0.25), 0.25)
    kind = "duration double, frame_rate double, n_frames int, scores array<double>, times array<double>"
    rows = documents.select("recording_id", F.from_json("document", kind).alias("d")).select("recording_id", "d.*", F.posexplode(F.arrays_zip("d.times", "d.scores")).alias("i", "p"))
    return rows.select("recording_id", "n_frames", "duration", "frame_rate", "i", r6("p.times", "t"), F.round("p.scores", 5).alias("score"))


def _layer_sql(sigma: float) -> str:
    """A bin's values ``m`` of n frames, smoothed."""
    return _smooth_sql("m", sigma)


@query(f"""WITH {MEL}, z AS (SELECT recording_id, count(*)::INT AS n FROM mel GROUP BY 1),
  k AS (SELECT m.recording_id, frame_idx * 10.0 / (n - 1) AS t, 1 + 3 * abs(mel[1]) AS rate FROM mel m JOIN z USING (recording_id) WHERE frame_idx % 3 = 0),
  q AS (SELECT m.recording_id, frame_idx, n, frame_idx * 10.0 / (n - 1) AS t FROM mel m JOIN z USING (recording_id)),
  lo AS (SELECT q.*, k.t AS t0, k.rate AS v0 FROM q ASOF JOIN k ON q.recording_id = k.recording_id AND q.t >= k.t - 1e-12),
  rt AS (SELECT lo.*, CASE WHEN k.t IS NULL OR k.t <= t0 THEN v0 ELSE v0 + (k.rate - v0) * ((lo.t - t0) / (k.t - t0)) END AS rate FROM lo ASOF LEFT JOIN k ON lo.recording_id = k.recording_id AND lo.t <= k.t + 1e-12),
  o AS (SELECT recording_id, n, frame_idx, sum(CASE WHEN frame_idx = 0 THEN 0 ELSE 10.0 / (n - 1) / greatest(rate, 0.5) END) OVER (PARTITION BY recording_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS out FROM rt),
  e AS (SELECT recording_id, n, max(out) AS last, greatest(1, floor(max(out) / (10.0 / n)))::INT AS m FROM o GROUP BY 1, 2),
  g AS (SELECT recording_id, i::INT AS frame_idx, m, n, CASE WHEN m > 1 THEN i * last / (m - 1) ELSE 0 END AS t FROM e, LATERAL (SELECT unnest(range(m)) AS i)),
  f AS (SELECT g.*, o.out AS t0, o.frame_idx AS s0 FROM g ASOF JOIN o ON g.recording_id = o.recording_id AND g.t >= o.out - 1e-12),
  s AS (SELECT f.recording_id, f.frame_idx, f.m, f.n, CASE WHEN o.out IS NULL OR o.out <= t0 THEN s0 ELSE s0 + (o.frame_idx - s0) * ((f.t - t0) / (o.out - t0)) END AS src FROM f ASOF LEFT JOIN o ON f.recording_id = o.recording_id AND f.t <= o.out + 1e-12),
  r AS (SELECT *, greatest(0.1, coalesce(CASE WHEN lag(src) OVER w IS NULL THEN lead(src) OVER w - src WHEN lead(src) OVER w IS NULL THEN src - lag(src) OVER w ELSE (lead(src) OVER w - lag(src) OVER w) / 2 END, 1)) AS ratio FROM s WINDOW w AS {ORDERED}),
  b AS (SELECT recording_id, k AS bin, z.n, list(mel[k + 1] ORDER BY frame_idx) AS m FROM mel JOIN z USING (recording_id), range(64) x(k) GROUP BY 1, 2, 3),
  sm AS (SELECT recording_id, bin, {_smooth_sql("m", 2.0)} AS x FROM b),
  mv AS (SELECT r.recording_id, bin, r.m AS n, list(x[floor(src)::INT + 1] + (coalesce(x[floor(src)::INT + 2], x[floor(src)::INT + 1]) - x[floor(src)::INT + 1]) * (src - floor(src)) ORDER BY frame_idx) AS m FROM r JOIN sm USING (recording_id) GROUP BY 1, 2, 3),
  ly AS (SELECT recording_id, bin, n, [{_layer_sql(0.3)}, {_layer_sql(0.3 + 2.2 / 3)}, {_layer_sql(0.3 + 4.4 / 3)}, {_layer_sql(2.5)}] AS layers FROM mv),
  w AS (SELECT recording_id, list(frame_idx ORDER BY frame_idx) AS i, list(src ORDER BY frame_idx) AS src, list(ratio ORDER BY frame_idx) AS ratio, min(ratio) AS lo, max(ratio) AS hi FROM r GROUP BY 1),
  c AS (SELECT *, list_transform(ratio, lambda v: round(least(greatest((v - lo) / (hi - lo) * 3 + 0.5 - 1e-12, 0), 3.4) - 0.5)::INT) AS ch FROM w),
  d AS (SELECT c.recording_id, bin, n, layers, ch, src, ratio FROM c JOIN ly USING (recording_id)),
  u AS (SELECT d.*, j, list_max(list_filter(range(greatest(0, j - 2), least(n - 1, j + 2)), lambda x: ch[x + 1] <> ch[x + 2])) AS cut FROM d, LATERAL (SELECT unnest(range(n)) AS j)),
  y AS (SELECT *, greatest(0, cut - 1) AS a, least(n, cut + 3) AS z FROM u)
  SELECT recording_id, j::INT AS frame_idx, bin::INT AS bin, round(src[j + 1], 5) AS src, round(ratio[j + 1], 5) AS ratio,
    round(CASE WHEN cut IS NULL OR n <= 8 THEN layers[ch[j + 1] + 1][j + 1] ELSE layers[ch[cut + 1] + 1][j + 1] * (1 - (j - a) / (z - a - 1)::DOUBLE) + layers[ch[cut + 2] + 1][j + 1] * ((j - a) / (z - a - 1)::DOUBLE) END, 5) + 0.0::DOUBLE AS value FROM y""")
def stretched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra over ten seconds, played at rates known for every third frame."""
    mel = mel_frames(spark, sf_dir)
    sized = mel.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"))
    knots = mel.where("frame_idx % 3 = 0").join(sized, "recording_id")
    curve = knots.select("recording_id", s.grid_time(F.col("frame_idx"), F.col("n"), F.lit(10.0)).alias("t"), (1 + 3 * F.abs(F.get("mel", F.lit(0)))).alias("rate"))
    out = stretch.stretch_frames(mel, curve, sized.select("recording_id", F.lit(10.0).alias("duration")))
    rows = out.select("recording_id", "frame_idx", F.round("src", 5).alias("src"), F.round("ratio", 5).alias("ratio"), F.posexplode("mel").alias("bin", "value"))
    return rows.withColumn("value", F.round("value", 5) + 0.0)


@query(f"""WITH {MEL}, {_MEL_SCORES}, s AS (SELECT recording_id, frame_idx, (blend - min(blend) OVER r) / (max(blend) OVER r - min(blend) OVER r) AS v, count(*) OVER r AS n FROM x WINDOW r AS (PARTITION BY recording_id)),
  fl AS (SELECT label AS recording_id, vec_id % 8 AS i, max(abs(embedding[2]::DOUBLE)) AS floor FROM embeddings GROUP BY 1, 2), k AS (SELECT recording_id, i * 10.0 / 7 AS t, floor FROM fl),
  q AS (SELECT recording_id, frame_idx, v, frame_idx * 10.0 / (n - 1) AS t FROM s),
  l AS (SELECT q.*, k.t AS t0, k.floor AS f0 FROM q ASOF JOIN k ON q.recording_id = k.recording_id AND q.t >= k.t - 1e-12),
  m AS (SELECT l.*, CASE WHEN k.t IS NULL OR k.t <= t0 THEN f0 ELSE f0 + (k.floor - f0) * ((l.t - t0) / (k.t - t0)) END AS floor FROM l ASOF LEFT JOIN k ON l.recording_id = k.recording_id AND l.t <= k.t + 1e-12)
  SELECT recording_id, frame_idx::INT AS frame_idx, round(t, 6)::DOUBLE AS t, round(greatest(v, floor), 6)::DOUBLE AS score FROM m""")
def scores_above_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectral importance, held up by floors at eight times of each recording."""
    at = (F.col("vec_id") % 8).alias("i")
    knots = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("recording_id"), at).agg(F.max(F.abs(F.get("embedding", F.lit(1)).cast("double"))).alias("floor"))
    floors = knots.select("recording_id", (F.col("i") * 10.0 / 7).alias("t"), "floor")
    n = F.count(F.lit(1)).over(Window.partitionBy("recording_id"))
    scores = importance.mel_importance(mel_frames(spark, sf_dir)).withColumn("t", s.grid_time(F.col("frame_idx"), n, F.lit(10.0)))
    return held_up(scores, floors).select("recording_id", "frame_idx", r6("t", "t"), r6("score", "score"))


HELD = 40
#: Samples of events as SQL: each value, centred, held for 40 samples.
SAMPLES = FRAMES + """, held AS (SELECT recording_id, (frame_idx * 40 + i)::BIGINT AS sample_idx, value / 500 - 0.5 AS x, value FROM frames, range(40) g(i))"""
CLICKY = SAMPLES + ", samples AS (SELECT recording_id, sample_idx, pow(value / 500, 6) AS x FROM held)"


def _samples(spark: SparkSession, sf_dir: str, shape=lambda v: v / 500 - 0.5) -> DataFrame:
    """(recording_id, sample_idx, value): each value of a recording held for 40 samples."""
    held = frames(spark, sf_dir).select("recording_id", "frame_idx", shape(F.col("value")).alias("value"), F.explode(F.sequence(F.lit(0), F.lit(HELD - 1))).alias("i"))
    return held.select("recording_id", (F.col("frame_idx").cast("long") * HELD + F.col("i")).alias("sample_idx"), "value")


def _clicky(v: Column) -> Column:
    return F.pow(v / 500, F.lit(6))


#: Samples of a block of the recordings made of events, a whole number of frames of any query here.
HELD_BLOCK = 24_000


def _blocks(spark: SparkSession, sf_dir: str, shape=lambda v: v / 500 - 0.5) -> DataFrame:
    """The same in blocks: a block's values are put together before they are held."""
    rows = frames(spark, sf_dir).select("recording_id", "frame_idx", shape(F.col("value")).alias("value"))
    at = F.floor(F.col("frame_idx") * HELD / HELD_BLOCK).cast("int").alias("block_idx")
    held = F.flatten(F.transform("r.value", lambda v: F.array_repeat(v, HELD)))
    grouped = dealt(rows.select("*", at), "recording_id", "block_idx").groupBy("recording_id", "block_idx").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "value"))).alias("r"))
    return grouped.select("recording_id", "block_idx", (F.col("block_idx").cast("long") * HELD_BLOCK).alias("start_sample"), held.alias("samples"))


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table of recordings, for queries that read them in several passes."""
    return written(_blocks(spark, sf_dir), "recordings")


def _samples_of(blocks: DataFrame) -> DataFrame:
    return chunks.samples_of(blocks).withColumn("value", F.round("value", 6) + 0.0)  # no negative zeros


def _rows(df: DataFrame) -> DataFrame:
    return df.select("recording_id", F.posexplode("samples").alias("sample_idx", "value")).withColumn("value", F.round("value", 6))


@query(f"""WITH {CLICKY}, e AS (SELECT recording_id, sample_idx // 48 AS f, avg(x * x) AS energy FROM samples GROUP BY 1, 2 HAVING count(*) = 48),
  m AS (SELECT *, median(energy) OVER w AS med, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY f ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
  c AS (SELECT *, coalesce(n = 21 AND med > 1e-10 AND energy > 5 * med, false) AS click FROM m),
  g AS (SELECT *, coalesce(lag(click) OVER o, false) AS after, coalesce(lead(click) OVER o, false) AS before FROM c WINDOW o AS (PARTITION BY recording_id ORDER BY f))
  SELECT s.recording_id, s.sample_idx, round(x * coalesce(least(CASE WHEN click THEN 0.5 ELSE 1 END, CASE WHEN after THEN 0.5 + 0.5 * (s.sample_idx % 48) / 47 ELSE 1 END,
    CASE WHEN before THEN 1 - 0.5 * (s.sample_idx % 48) / 47 ELSE 1 END), 1), 6) + 0.0::DOUBLE AS value FROM samples s LEFT JOIN g ON g.recording_id = s.recording_id AND g.f = s.sample_idx // 48""")
def declick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples_of(chunks.declick_blocks(_blocks(spark, sf_dir, _clicky), HELD_BLOCK))


#: Flags of frames of 48 samples by amplitude (c1) and by spectrum (c2), as SQL: the power of the bins 0 to 24 follows
#: from the sum of squares and the bins 0 and 24 alone, and of these only bin 0 lies below 300 Hz.
_CLICK_FLAGS = CLICKY + """, e AS (SELECT recording_id, sample_idx // 48 AS f, avg(x * x) AS energy, pow(sum(x), 2) AS low,
    (48 * sum(x * x) + pow(sum(x), 2) + pow(sum(CASE WHEN sample_idx % 2 = 0 THEN x ELSE -x END), 2)) / 50 AS wide FROM samples GROUP BY 1, 2 HAVING count(*) = 48),
  m AS (SELECT *, median(energy) OVER w AS m1, median(wide) OVER w AS m2, median(low) OVER w AS m3, count(*) OVER w AS n FROM e
    WINDOW w AS (PARTITION BY recording_id ORDER BY f ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
  c AS (SELECT recording_id, count(*) FILTER (n = 25 AND m1 > 0 AND energy > 3 * m1) AS c1, count(*) FILTER (n = 25 AND (wide > 4 * greatest(m2, 1e-10) OR low > 4 * greatest(m3, 1e-10))) AS c2 FROM m GROUP BY 1)"""


def _spectral_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_blocks.spectral_click_counts(_blocks(spark, sf_dir, _clicky), HELD_BLOCK)


@query(f"WITH {_CLICK_FLAGS} SELECT recording_id, c2 AS n_clicks FROM c")
def spectral_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectral_clicks(spark, sf_dir)


@query(f"""WITH {_CLICK_FLAGS}, d AS (SELECT recording_id, count(*) / 24000.0 AS duration FROM samples GROUP BY 1)
  SELECT recording_id, greatest(c1, c2) AS n_clicks, round(CASE WHEN duration < 0.01 THEN 0 ELSE greatest(c1, c2) / duration END, 4)::DOUBLE AS clicks_per_second FROM c JOIN d USING (recording_id)""")
def clicks_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir, _clicky).withColumnRenamed("sample_idx", "frame_idx")
    durations = samples.groupBy("recording_id").agg((F.count(F.lit(1)) / signal.SAMPLE_RATE).alias("duration"))
    found = w.clicks_per_second(w.frame_energy(samples, 48), _spectral_clicks(spark, sf_dir), durations)
    return found.withColumn("clicks_per_second", F.round("clicks_per_second", 4))


@query(f"""WITH {SAMPLES}, l AS (SELECT recording_id, list(x ORDER BY sample_idx) AS x, count(*)::INT AS n FROM held GROUP BY 1),
  f AS (SELECT recording_id, n, g::INT AS frame_idx, list_transform(range(64), lambda i: x[CASE WHEN g * 16 + i < 32 THEN 32 - g * 16 - i WHEN g * 16 + i - 32 < n THEN g * 16 + i - 32 ELSE 2 * (n - 1) - (g * 16 + i - 32) END + 1]
    * (0.5 - 0.5 * cos(2 * pi() * i / 64))) AS y FROM l, LATERAL (SELECT unnest(range(1 + n // 16)) AS g)),
  d AS (SELECT recording_id, frame_idx, k, sqrt(pow(list_sum(list_transform(range(64), lambda i: y[i + 1] * cos(2 * pi() * k * i / 64))), 2) + pow(list_sum(list_transform(range(64), lambda i: y[i + 1] * sin(2 * pi() * k * i / 64))), 2)) AS mag FROM f, range(33) r(k)),
  p AS (SELECT j, 700 * (pow(10, j * log10(1 + 12000 / 700.0) / 11) - 1) AS hz FROM range(12) r(j)),
  b AS (SELECT a.j, k, greatest(0, least((k * 375.0 - a.hz) / (m.hz - a.hz), (z.hz - k * 375.0) / (z.hz - m.hz))) AS weight FROM p a JOIN p m ON m.j = a.j + 1 JOIN p z ON z.j = a.j + 2, range(33) r(k))
  SELECT recording_id, frame_idx, j::INT AS bin, round(ln(greatest(sum(weight * mag), 1e-5)), 5) AS value FROM d JOIN b USING (k) GROUP BY 1, 2, 3""")
def mel_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal_blocks.mel_frames(_blocks(spark, sf_dir), HELD_BLOCK, n_fft=64, hop=16, n_mels=10)
    return found.select("recording_id", "frame_idx", F.posexplode("mel").alias("bin", "value")).withColumn("value", F.round("value", 5))


@query(f"""WITH {FRAMES}, z AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1),
  c AS (SELECT recording_id, n, i, greatest(0, i * 40 - 4) AS a, least(i * 40 + 44, n) AS e FROM z, LATERAL (SELECT unnest(range(CASE WHEN n <= 40 THEN 1 ELSE (n + 39) // 40 END)) AS i)),
  l AS (SELECT *, (CASE WHEN n <= 40 THEN n ELSE e - a END + 1) // 2 AS len, CASE WHEN i > 0 THEN 2 ELSE 0 END AS fade_in, CASE WHEN i * 40 + 40 < n THEN greatest(0, e - i * 40 - 40) // 2 ELSE 0 END AS fade_out FROM c),
  b AS (SELECT *, least(fade_in, len) AS blend FROM l), k AS (SELECT *, greatest(0, len - fade_out - blend) AS kept FROM b),
  o AS (SELECT *, coalesce(sum(kept) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - blend AS begins, coalesce(lead(blend) OVER (PARTITION BY recording_id ORDER BY i), 0) AS next FROM k),
  p AS (SELECT o.recording_id, begins + j AS sample_idx, f.value * CASE WHEN j < blend THEN CASE WHEN blend > 1 THEN j / (blend - 1)::DOUBLE ELSE 0 END ELSE 1 END
      * CASE WHEN j >= blend AND j - (blend + kept - next) >= 0 THEN CASE WHEN next > 1 THEN 1 - (j - (blend + kept - next)) / (next - 1)::DOUBLE ELSE 1 END ELSE 1 END AS v
    FROM o, LATERAL (SELECT unnest(range(blend + kept)) AS j), frames f WHERE f.recording_id = o.recording_id AND f.frame_idx = a + 2 * j)
  SELECT recording_id, sample_idx::BIGINT AS sample_idx, round(sum(v), 6) AS value FROM p GROUP BY 1, 2""")
def chunked_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long recordings in chunks of 40 samples with 4 of overlap, every second sample played, put together again."""
    blocks = chunks.in_blocks(frames(spark, sf_dir).select("recording_id", F.col("frame_idx").alias("sample_idx"), "value"), 16)
    out = chunks.process_chunked(blocks, 2.0, 1, 16, lambda x, t, r: x[::2], 40, 4)
    return chunks.samples_of(out).withColumn("value", F.round("value", 6))


@query(f"""WITH {FRAMES} SELECT recording_id, i::INT AS frame_idx, CASE WHEN n > 1 THEN i * d / (n - 1) ELSE 0 END AS t, 3.0::DOUBLE AS rate
  FROM (SELECT recording_id, max(t) AS d, greatest(1, floor(max(t) / 7200))::INT AS n FROM frames GROUP BY 1), LATERAL (SELECT unnest(range(n)) AS i)""")
def uniform_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = frames(spark, sf_dir).groupBy("recording_id").agg(F.max("t").alias("duration"))
    return rates.uniform_rate_schedule(durations, 3.0, 7200.0)


@query("""WITH p AS (SELECT doc_id, lang, source, n_chars / 1000.0 AS e FROM documents), r AS (SELECT source AS recording_id, lang AS label, round(avg(e), 6)::DOUBLE AS wer, round(max(e), 6)::DOUBLE AS cer FROM p GROUP BY 1, 2)
  SELECT *, coalesce(wer = min(wer) OVER (PARTITION BY recording_id), false) AS best FROM r""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings, here languages, by error, and the best of each recording, here source."""
    e = F.col("n_chars") / 1000
    results = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("recording_id"), F.col("lang").alias("label")).agg(r6(F.avg(e), "wer"), r6(F.max(e), "cer"))
    return evaluation.evaluation_report(results)


@query("""SELECT user_id % 7 AS epoch, event_type AS measure, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1, 2""")
def validation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = read(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("epoch"), F.col("event_type").alias("measure"), "value")
    return evaluation.validation_means(batches).withColumn("mean", F.round("mean", 6))


@query("""SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id) LIMIT 50""")
def drawn_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.drawn_trials(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


@query("""SELECT doc_id, lang FROM documents ORDER BY lang, doc_id LIMIT 5""")
def first_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_items(read(spark, sf_dir, "documents").select("doc_id", "lang"), 5, "lang", "doc_id")


@query("""SELECT label_row.doc_id, coalesce(quality::VARCHAR, '3') AS speed, '0.7' AS smoothing, toxic::VARCHAR AS gamma FROM labels AS label_row""")
def merged_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    given = F.map_filter(F.create_map(F.lit("speed"), text("quality"), F.lit("gamma"), text("toxic")), lambda k, v: v.isNotNull())
    defaults = F.create_map(F.lit("speed"), F.lit("3"), F.lit("smoothing"), F.lit("0.7"))
    merged = read(spark, sf_dir, "labels").select("doc_id", evaluation.merged_options(defaults, given).alias("m"))
    return merged.select("doc_id", *[F.col("m")[k].alias(k) for k in ("speed", "smoothing", "gamma")])


@query(f"""WITH {FRAMES}, z AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1)
  SELECT z.recording_id, (i // 32)::INT AS frame_idx, (i % 32)::INT AS sample_idx, coalesce(f.value, 0) AS value
  FROM z, LATERAL (SELECT unnest(range((n + 31) // 32 * 32)) AS i) LEFT JOIN frames f ON f.recording_id = z.recording_id AND f.frame_idx = i""")
def codec_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 values, the last one filled up with zeros."""
    rows = frames(spark, sf_dir).select("recording_id", "frame_idx", "value")
    return chunks.codec_frames(rows, 32).select("recording_id", "frame_idx", "sample_idx", "value")


@query(f"""WITH {MEL}, p AS (SELECT recording_id, frame_idx, i, least(exp(mel[i + 1] * 4), 100) AS m, mel[33 + i] AS a FROM mel, range(32) r(i))
  SELECT recording_id, frame_idx::INT AS frame_idx, i::INT AS bin, round(m * cos(a), 6) AS re, round(m * sin(a), 6) AS im FROM p""")
def polar_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = mel_frames(spark, sf_dir).select("recording_id", "frame_idx", F.posexplode(F.arrays_zip(F.slice("mel", 1, 32).alias("m"), F.slice("mel", 33, 32).alias("a"))).alias("bin", "p"))
    re, im = s.from_polar(F.col("p.m") * 4, F.col("p.a"))
    return bins.select("recording_id", "frame_idx", "bin", r6(re, "re"), r6(im, "im"))


_MIRRORED_SQL = "list_transform(range(0, n), lambda i: list_sum(list_transform(range(-6, 7), lambda d: exp(-(d * d) / 8.0) * m[1 + least(abs(i + d) % (2 * (n - 1)), 2 * (n - 1) - abs(i + d) % (2 * (n - 1)))])) / list_sum(list_transform(range(-6, 7), lambda d: exp(-(d * d) / 8.0))))"
_AT_SQL = "{x}[floor({src})::INT + 1] + (coalesce({x}[floor({src})::INT + 2], {x}[floor({src})::INT + 1]) - {x}[floor({src})::INT + 1]) * ({src} - floor({src}))"


@query(f"""WITH {MEL}, b AS (SELECT recording_id, k AS bin, count(*)::INT AS n, list(mel[k + 1] ORDER BY frame_idx) AS m FROM mel, range(64) x(k) GROUP BY 1, 2),
  s AS (SELECT recording_id, bin, n, greatest(1, round_even(n / 3.0, 0))::INT AS short, {_MIRRORED_SQL} AS x FROM b),
  d AS (SELECT *, list_transform(range(short), lambda i: {_AT_SQL.format(x="x", src="(CASE WHEN short > 1 THEN i * (n - 1) / (short - 1)::DOUBLE ELSE 0 END)")}) AS y FROM s)
  SELECT recording_id, j::INT AS frame_idx, bin::INT AS bin, round({_AT_SQL.format(x="y", src="(j * (short - 1) / (n - 1)::DOUBLE)")}, 5) + 0.0::DOUBLE AS value FROM d, LATERAL (SELECT unnest(range(n)) AS j)""")
def resample_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra down to a third of their frames and back."""
    out = stretch.resample_roundtrip(mel_frames(spark, sf_dir), 3.0, 2.0)
    return out.select("recording_id", "frame_idx", F.posexplode("mel").alias("bin", "value")).withColumn("value", F.round("value", 5) + 0.0)


_DRAWN = "(('0x' || substr(md5('1-{what}-' || recording_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"""WITH {SAMPLES}, l AS (SELECT recording_id, count(*)::INT AS n, list(x ORDER BY sample_idx) AS x, max(abs(x)) AS peak FROM held GROUP BY 1),
  p AS (SELECT *, floor({_DRAWN.format(what="place")} * greatest(1, n - 2399))::INT AS start, pow(10, (-6 + 5 * {_DRAWN.format(what="gain")}) / 20) AS level FROM l)
  SELECT recording_id, i::INT AS sample_idx, round(x[CASE WHEN n < 2400 THEN i % n ELSE start + i END + 1] * CASE WHEN peak > 0 THEN level / peak ELSE 1 END, 6) + 0.0::DOUBLE AS value FROM p, range(2400) t(i)""")
def training_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(audio.training_items(_blocks(spark, sf_dir), HELD_BLOCK, 2400, True, 1))
    return rows.withColumn("value", F.col("value") + 0.0)


@query()
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples_of(signal_blocks.post_process(_recordings(spark, sf_dir), HELD_BLOCK))


@query()
def accelerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on held values, twice as fast."""
    out = accelerate(_recordings(spark, sf_dir), 2.0, HELD_BLOCK)
    return _samples_of(out)


@query()
def spectral_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples_of(signal_blocks.spectral_gate(_recordings(spark, sf_dir), HELD_BLOCK))


@query()
def prosodic_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal_blocks.prosodic_envelope(_blocks(spark, sf_dir), HELD_BLOCK)
    return found.select("recording_id", "frame_idx", r6("t", "t"), r6("value", "value"))


@query(f"""WITH RECURSIVE {FRAMES}, run AS (SELECT recording_id, frame_idx, 0.2 * value AS y FROM frames WHERE frame_idx = 0
    UNION ALL SELECT f.recording_id, f.frame_idx, 0.8 * y + 0.2 * f.value FROM run JOIN frames f ON f.recording_id = run.recording_id AND f.frame_idx = run.frame_idx + 1)
  SELECT recording_id, frame_idx::INT AS frame_idx, round(y, 6) AS value FROM run""")
def recursive_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrence of the first order, from rest."""
    rows = frames(spark, sf_dir).select("recording_id", "frame_idx", "value")
    return recurrences.filtered(rows, "value", np.array([0.2, 0.0, 0.0, -0.8, 0.0])).select("recording_id", "frame_idx", r6("value", "value"))


#: The mean magnitude of each bin of frames of 64 samples, half a window apart, of a list ``x`` of n samples, as SQL.
_MEAN_SPECTRUM = """list_transform(range(33), lambda b: greatest(1e-10, list_avg(list_transform(range(greatest(1, (greatest(n, 64) - 64) // 32)), lambda k: sqrt(
    pow(list_sum(list_transform(range(64), lambda i: coalesce({x}[k * 32 + i + 1], 0) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * cos(2 * pi() * b * i / 64))), 2)
    + pow(list_sum(list_transform(range(64), lambda i: coalesce({x}[k * 32 + i + 1], 0) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) * sin(2 * pi() * b * i / 64))), 2))))))"""


@query(f"""WITH {SAMPLES}, l AS (SELECT recording_id, count(*)::INT AS n, list(x ORDER BY sample_idx) AS x, list(pow(value / 500, 6) ORDER BY sample_idx) AS ref FROM held GROUP BY 1),
  sp AS (SELECT *, {_MEAN_SPECTRUM.format(x="x")} AS have, {_MEAN_SPECTRUM.format(x="ref")} AS want FROM l),
  r AS (SELECT *, list_transform(range(1, 34), lambda b: pow(10, least(greatest(20 * log10(want[b] / (have[b] + 1e-10) + 1e-10), -4.5), 4.5) / 20)) AS raw FROM sp),
  g AS (SELECT recording_id, n AS total, x, 33 AS n, raw FROM r), h AS (SELECT recording_id, total AS n, x, {_smooth_sql("raw", 5.0)} AS gain FROM g),
  k AS (SELECT recording_id, n, x, list_transform(range(64), lambda m: list_sum(list_transform(range(33), lambda b: CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END * gain[b + 1] * cos(2 * pi() * b * m / 64))) / 64) AS kernel FROM h),
  f AS (SELECT recording_id, n, kernel, f, list_transform(range(64), lambda i: (0.5 - 0.5 * cos(2 * pi() * i / 64)) * coalesce(CASE WHEN f * 32 + i - 32 < 0 THEN x[32 - f * 32 - i + 1] WHEN f * 32 + i - 32 < n THEN x[f * 32 + i - 32 + 1]
      WHEN f * 32 + i - 32 < n + 32 THEN x[2 * (n - 1) - (f * 32 + i - 32) + 1] ELSE 0 END, 0)) AS y FROM k, LATERAL (SELECT unnest(range((n + 31) // 32 + 1)) AS f)),
  o AS (SELECT recording_id, n, f, list_transform(range(64), lambda i: list_sum(list_transform(range(64), lambda j: y[j + 1] * kernel[(i - j + 64) % 64 + 1]))) AS z FROM f),
  p AS (SELECT recording_id, n, f * 32 + i - 32 AS sample_idx, z[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v, pow(0.5 - 0.5 * cos(2 * pi() * i / 64), 2) AS q FROM o, range(64) t(i))
  SELECT recording_id, sample_idx::BIGINT AS sample_idx, round(sum(v) / greatest(sum(q), 1e-8), 6) + 0.0::DOUBLE AS value FROM p WHERE sample_idx BETWEEN 0 AND n - 1 GROUP BY 1, 2""")
def match_tilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean spectrum of held values brought towards that of their sixth powers, in windows of 64."""
    return _samples_of(signal_blocks.match_tilt(_blocks(spark, sf_dir, _clicky), _blocks(spark, sf_dir), HELD_BLOCK, 64))
