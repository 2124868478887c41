"""Document fingerprints by winnowing.

A text's words are hashed, a rolling (cyclic polynomial) hash covers every
``GRAM_WORDS`` words in a row, and of every ``WINDOW`` hashes in a row the
smallest is kept, the rightmost of equals.  Positions are kept with the
hashes.  So any run of ``WINDOW + GRAM_WORDS - 1`` words that two texts share
leaves a common hash in both fingerprints.

The first ``GRAM_WORDS - 1`` grams reach before the text's start, where the
word hash is 0, so short texts have a gram per word as well; texts of fewer
than ``WINDOW`` words form one window for each of their grams' suffixes and
keep all that are smallest in one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, shuffle_partitions, table

GRAM_WORDS = 5
WINDOW = 8
#: A fingerprint entry is a 33-bit hash above 30 bits that fall as the position rises; no string holds 2**30 words.
POSITION_BITS = 30
POSITION_MASK = (1 << POSITION_BITS) - 1
LOWEST = -(1 << 63)
#: Bytes of text that a range of rows holds on average, and most ranges; beyond it ranges grow, and are sorted by spilling.
RANGE_BYTES, MOST_RANGES = 1 << 23, 1 << 13


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rotate(x: Column, bits: int) -> Column:
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def entries(text: Column) -> Column:
    """Fingerprint of a text: hashes with positions, in text order."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    before = F.array_repeat(F.lit(0).cast("long"), GRAM_WORDS - 1)
    hashes = F.concat(before, F.transform(words, lambda w: F.xxhash64(w)))

    def grams(h: Column) -> Column:
        def gram(i: Column) -> Column:
            rolled = F.get(h, i + (GRAM_WORDS - 1))
            for j in range(GRAM_WORDS - 1):
                rolled = rolled.bitwiseXOR(rotate(F.get(h, i + j), GRAM_WORDS - 1 - j))
            place = F.lit(POSITION_MASK) - i
            return F.shiftleft(F.shiftrightunsigned(rolled, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(place.cast("long"))

        n = F.size(h) - (GRAM_WORDS - 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), gram)).otherwise(F.array().cast("array<bigint>"))

    def winnow(g: Column) -> Column:
        n = F.size(g)
        # a short text's windows are the suffixes of its grams
        spans = F.when(n >= WINDOW, F.sequence(F.lit(1), n - (WINDOW - 1))).otherwise(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
        kept = F.array_distinct(F.transform(spans, lambda i: F.array_min(F.slice(g, i, WINDOW))))
        return F.when(n > 0, kept).otherwise(F.array().cast("array<bigint>"))

    return let(let(hashes, grams), winnow)


def entry_hashes(found: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, POSITION_BITS)))


def entry_positions(found: Column) -> Column:
    """Word positions of a fingerprint's entries."""
    return F.transform(found, lambda x: F.lit(POSITION_MASK) - x.bitwiseAND(F.lit(POSITION_MASK)))


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x))), " ")


def likeness(x: Column, y: Column) -> Column:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def range_bounds(quantiles: list[int]) -> list[tuple[int, int]]:
    """Bounds (key, text hash) of the ranges, ascending.

    A key that is several quantiles holds that many ranges' rows, which the
    hashes of their texts, even over all longs, tell apart.
    """
    often = Counter(quantiles)
    return [(key, LOWEST + ((i << 64) // often[key])) for key in sorted(often) for i in range(often[key])]


def range_of(key: Column, text_hash: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of ``bounds`` not above (key, text_hash), in two steps of about sqrt(n)."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    kind = "array<struct<k:bigint,h:bigint>>"
    pairs = lambda values: F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in values]).cast(kind)
    count = lambda values: F.size(F.filter(values, lambda b: (b["k"] < key) | ((b["k"] == key) & (b["h"] <= text_hash))))
    coarse = count(pairs([g[0] for g in groups[1:]]))
    return (coarse * width + count(F.get(F.array(*[pairs(g) for g in groups]), coarse))).cast("int")


def with_next(docs: DataFrame, extra: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, x, next_text, next_x) with x = ``extra(text)``.

    The next row is the one with the next lower doc_id; after the lowest comes
    the highest; of equal ids, the higher text hash first; a null id is lowest.
    Rows are dealt into ranges of (doc_id, text hash), and each range also gets
    the first row of the range below, so that one shuffle of the texts serves
    and no task sees more than its range.  Repeated rows of an id that holds
    much of the table are counted before and told apart after.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("_key"))
    n = max(2 * shuffle_partitions(spark), min(MOST_RANGES, math.ceil((keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / RANGE_BYTES)))
    quantiles = keyed.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"] or []
    hot = [key for key, times in Counter(quantiles).items() if times > 1]
    one = keyed.withColumn("_n", F.lit(1).cast("long"))
    if hot:  # fewer than half of the ranges
        is_hot = F.col("_key").isin(hot)
        counted = keyed.where(is_hot).groupBy("doc_id", "text", "_key").agg(F.count(F.lit(1)).alias("_n"))
        one = one.where(~is_hot).unionByName(counted)
    hashed = one.withColumn("_hash", F.xxhash64("text"))
    dealt = hashed.withColumn("_bucket", range_of(F.col("_key"), F.col("_hash"), range_bounds(quantiles)))
    # one row per range reaches the driver
    top = F.max(F.struct("_key", "_hash")).alias("top")
    tops = sorted((r["_bucket"], *r["top"]) for r in dealt.select("_bucket", "_key", "_hash").groupBy("_bucket").agg(top).collect())
    above = [t[0] for t in tops[1:]] + [t[0] for t in tops[:1]]
    halo = spark.createDataFrame(
        [(*t, to, i == len(tops) - 1) for i, (t, to) in enumerate(zip(tops, above, strict=True))],
        "_of int, _top long, _top_hash long, _to int, _last boolean",
    )
    is_top = (F.col("_bucket") == F.col("_of")) & (F.col("_key") == F.col("_top")) & (F.col("_hash") == F.col("_top_hash"))
    met = dealt.join(F.broadcast(halo), is_top, "left")
    place = lambda bucket, last, lent: F.struct(bucket.alias("bucket"), last.alias("last"), lent.alias("lent"))
    own = F.array(place(F.col("_bucket"), F.lit(False), F.lit(False)))
    both = F.concat(own, F.array(place(F.col("_to"), F.col("_last"), F.lit(True))))
    rows = met.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), own).otherwise(both)))
    rows = rows.select("doc_id", "text", "_key", "_hash", "_n", F.col("_at.bucket").alias("_bucket"), F.col("_at.last").alias("_last"), F.col("_at.lent").alias("_lent"))
    rows = rows.repartitionById(n, F.col("_bucket")).withColumn("x", extra(F.col("text")))
    order = Window.partitionBy("_bucket").orderBy("_last", F.col("_key").desc(), F.col("_hash").desc(), "text", "_lent")
    found = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_x", F.lead("x").over(order)).where(~F.col("_lent"))
    if hot:  # of equal rows, all but the last have their own text next
        pair = lambda n, text, x: F.struct(n.alias("n"), text.alias("text"), x.alias("x"))
        nexts = F.array(pair(F.lit(1).cast("long"), F.col("next_text"), F.col("next_x")), pair(F.col("_n") - 1, F.col("text"), F.col("x")))
        found = found.withColumn("_next", F.explode(F.filter(nexts, lambda p: p["n"] > 0)))
        found = found.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_next.n"))))
        found = found.withColumn("next_text", F.col("_next.text")).withColumn("next_x", F.col("_next.x"))
    return found.select("doc_id", "text", "x", "next_text", "next_x")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with likenesses.

    Columns: doc_id, n_chars, edited_sha256, entries, positions,
    edited_entries, near_edited, near_next.  A null text counts as empty; an
    empty text has no entries, and two such are alike to degree 1.  Rows with
    one doc_id follow each other in descending order of their texts' XXH64; a
    single row is its own next.  Columns besides doc_id and text are ignored.
    """
    rows = with_next(docs, entries)
    n_chars = F.length("text").cast("long")
    third = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.col("n_chars").cast("int") - third
    edited = F.concat(F.col("text").substr(F.lit(1), head), F.col("next_text").substr(F.lit(1), third))
    rows = rows.withColumn("n_chars", n_chars).withColumn("edited", edited)
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("x").alias("entries"),
        entries(F.col("edited")).alias("edited_entries"), entry_hashes(F.col("x")).alias("_own"), entry_hashes(F.col("next_x")).alias("_next"),
    )
    rows = rows.withColumn("_edited", entry_hashes(F.col("edited_entries")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "entries", entry_positions(F.col("entries")).alias("positions"), "edited_entries",
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("entries")).alias("fingerprint"),
        as_string(F.col("edited_entries")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
