"""Mixing sources to target weights with hash-threshold histograms.

Each document has a hash in [0, 2**60).  A source whose target is ``e`` times
its size and a rest takes all its documents ``e`` times and, once more, those
whose hash lies below a threshold.  The threshold is found without sorting:
sizes are summed by source and by the hash's leading bits, the running sum
tells in which bucket the rest runs out, and only that bucket is split by the
next bits.  Each level is a map-side combined sum of a fixed number of buckets
per source, so a hot source costs no more than any other.  Rows of equal doc_id
and text share a hash; where it is the last one, as many of them are taken as
come nearest to the target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, table

HASH_BITS = 60
LEVEL_BITS = 12
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of all sources, from (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; together
    they share the sum of all sizes, none above ``MAX_REPEATS`` times its own.
    Sharing out the excess again and again ends at ``min(cap, level * weight)``
    with one level for all; sorted by ``cap / weight``, the capped sources come
    first and the level follows from two running sums.  One row per source is
    all that meets in the windows here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight"))
        .withColumn("is_open", F.col("level") * F.col("weight") <= F.col("cap"))
    )
    first_open = F.min_by(F.when(F.col("is_open"), F.col("level")), F.when(F.col("is_open"), F.col("cap") / F.col("weight"))).over(everything)
    level = F.coalesce(first_open, F.lit(float("inf")))
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return levels.select("source", "source_size", F.when(F.col("total") == 0, 0.0).otherwise(target).alias("target"))


def mixing_plan(sized: DataFrame) -> DataFrame:
    """Per source: source_size, target, full repeats, hash threshold and how many rows of just that hash are taken once more.

    ``sized`` has source, size and hash (``mix_hash``).  Rows below the
    threshold are taken once more.  Of the rows at the threshold, which are
    equal in doc_id and text, ``of_last`` are, the number nearest to the target.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = source_targets(sizes).withColumn(
        "repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    plan = materialise(
        plan.withColumn("rest", F.col("target") - (F.col("repeats") * F.col("source_size")).cast("double")).withColumn("prefix", F.lit(0).cast("long")),
        "mix-plan",
    )
    rows = sized
    edge = plan
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        keyed = rows.withColumn("bucket", F.shiftright("mix_hash", shift))
        sums = keyed.groupBy("source", "bucket").agg(F.sum("size").cast("long").alias("words"), F.count(F.lit(1)).alias("rows"))
        run = Window.partitionBy("source").orderBy("bucket")
        known = edge.select("source", F.col("rest").alias("rest0"), F.col("prefix").alias("prefix0"))
        totals = sums.withColumn("upto", F.sum("words").over(run)).withColumn("below", F.col("upto") - F.col("words"))
        crossed = totals.join(known, totals["source"].eqNullSafe(known["source"])).where(
            (F.col("upto") > F.col("rest0")) & (F.col("words") > 0)
        )
        found = crossed.groupBy(totals["source"].alias("source")).agg(
            F.min_by(F.struct("bucket", "below", "words", "rest0", "rows"), "bucket").alias("b")
        )
        edge = materialise(
            found.select(
                "source",
                (F.col("b.rest0") - F.col("b.below")).alias("rest"),
                F.col("b.bucket").alias("prefix"),
                F.col("b.words").alias("words"),
                F.col("b.rows").alias("rows"),
            ),
            f"mix-edge{level}",
        )
        if level + 1 < HASH_BITS // LEVEL_BITS:
            only = edge.select(F.col("source").alias("edge_source"), "prefix")
            rows = keyed.join(
                only, keyed["source"].eqNullSafe(only["edge_source"]) & (keyed["bucket"] == only["prefix"]), "left_semi"
            ).drop("bucket")
    # prefix is now a single hash value; its rows are of one size, but for what hashes may share by chance
    cut = edge.select(
        F.col("source").alias("cut_source"),
        F.col("prefix").alias("threshold"),
        F.floor(F.col("rest") * F.col("rows") / F.col("words") + 0.5).cast("long").alias("of_last"),
    )
    none = F.lit(0).cast("long")
    return plan.join(cut, plan["source"].eqNullSafe(cut["cut_source"]), "left").select(
        "source", "source_size", "target", "repeats", F.coalesce("threshold", none).alias("threshold"), F.coalesce("of_last", none).alias("of_last")
    )


def mix_hash(docs: DataFrame):
    """60-bit hash of doc_id and text; SQL engines with md5 can repeat it."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col("text"), F.lit("-")))]
    digest = F.md5(F.concat(parts[0], F.lit("|"), parts[1]))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mix_hash and a number of every row, written once."""
    number = F.monotonically_increasing_id().alias("row_id")
    return materialise(docs.select("doc_id", "source", word_count().alias("size"), mix_hash(docs).alias("mix_hash"), number), "mix")


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, mix_hash, ...) with source_size, target, ``whole``, ``below`` the threshold or ``last``, at it, and ``of_last``."""
    at = [(F.col("threshold") > F.col("mix_hash")).alias("below"), (F.col("threshold") == F.col("mix_hash")).alias("last")]
    known = plan.select(F.col("source").alias("_source"), "source_size", "target", F.col("repeats").alias("whole"), "threshold", "of_last")
    return rows.join(known, rows["source"].eqNullSafe(known["_source"])).select(*rows.columns, "source_size", "target", "whole", "of_last", *at)


def mix_documents(docs: DataFrame) -> DataFrame:
    """Return doc_id, source, size, mix_hash, source_size, target, repeats for all rows.

    ``repeats`` (0 to 3) is how often the mix takes the row.  A null text has
    size 0; such rows, and all rows of a source of size 0, are taken as their
    hash says and add nothing.  A null source is a source, in the last place.
    Rows of equal doc_id and text are taken alike, but for those at the
    threshold of their source, of which some are taken once more, the first by
    partition and row.  An empty input gives an empty result, and columns
    besides doc_id, text and source are ignored.
    """
    sized = sized_documents(docs)
    plan = materialise(mixing_plan(sized), "mix-plan")
    rows = planned(sized, plan)
    # only the rows at a threshold are numbered: within their partition of the input, then by the counts of those before it
    last = rows.where("last and of_last > 0").select("source", "row_id", "of_last", F.shiftright("row_id", 33).alias("part"))
    counts = last.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = materialise(counts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), earlier.alias("before")), "mix-last")
    met = last.join(counts, last["source"].eqNullSafe(counts["_source"]) & (last["part"] == counts["_part"]))
    place = F.row_number().over(Window.partitionBy("source", "part").orderBy("row_id")) + F.col("before")
    chosen = met.withColumn("place", place).where("place <= of_last").select(F.col("row_id").alias("_row"), F.lit(1).cast("long").alias("_more"))
    more = F.col("below").cast("long") + F.coalesce("_more", F.lit(0))
    taken = rows.join(chosen, rows["row_id"] == chosen["_row"], "left").withColumn("repeats", F.col("whole") + more)
    return taken.select("doc_id", "source", "size", "mix_hash", "source_size", "target", "repeats")


#: Copies of a row at the threshold that are made in one place.
COPIES = 1000


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns as they are.

    The plan, a row per source, is written first: so its size is known and
    Spark broadcasts it only while it is small.  Rows at a threshold, equal in
    doc_id and text, are told apart by their other columns, the first by JSON
    first; equal ones come as copies of one of them.
    """
    plan = materialise(mixing_plan(sized_documents(docs)), "mix-plan")
    packed = docs.select(F.struct("*").alias("_doc"), "source", mix_hash(docs).alias("mix_hash"))
    rows = planned(packed, plan)
    often = F.col("whole") + F.col("below").cast("long")
    taken = rows.where(often > 0).select("_doc", F.explode(F.sequence(F.lit(1), often.cast("int"))))
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    told = F.to_json(F.struct(*[F.col(f"_doc.`{c}`").alias(f"c{i}") for i, c in enumerate(others)])) if others else F.lit("")
    last = rows.where("last and of_last > 0").withColumn("told", told)
    kinds = last.groupBy("source", "told").agg(F.any_value("_doc").alias("_doc"), F.any_value("of_last").alias("of_last"), F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("told"))
    copies = kinds.withColumn("k", F.least("n", F.col("of_last") - (upto - F.col("n")))).where("k > 0")
    dealt = copies.select("_doc", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1, F.lit(COPIES).cast("long"))).alias("at"))
    few = F.explode(F.sequence(F.col("at"), F.least(F.col("at") + COPIES, F.col("k")) - 1))
    return taken.select("_doc.*").unionByName(dealt.repartition(F.col("at")).select("_doc", few).select("_doc.*"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def _oracle() -> str:
    hash_sql = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, '-'))), 1, 15))::BIGINT"
    return f"""
WITH sized AS (
  SELECT doc_id, source, {hash_sql} AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 3 AS cap FROM src
), levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
            / (sum(weight) OVER ()
               - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level
  FROM ranked
), targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * coalesce((SELECT min_by(level, cap / weight) FROM levels WHERE level * weight <= cap), 'inf'::DOUBLE)) AS target
  FROM levels
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), running AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - (p.whole * p.source_size)::DOUBLE AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, h) AS tied, count(*) OVER (PARTITION BY s.source, h) AS equal_rows,
         row_number() OVER (PARTITION BY s.source, h ORDER BY doc_id) AS place
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN upto <= rest THEN 1 WHEN tied > 0 AND place <= floor((rest - (upto - tied)) * equal_rows / tied + 0.5) THEN 1 ELSE 0 END) AS taken
FROM running
"""


ORACLE_SQL = {"op4_mixing": _oracle()}
