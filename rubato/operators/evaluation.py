"""Evaluation: error rates, listening tests, phase deviation, splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.length(reference)


def as_symbols(parts: Column, alphabet: Column) -> Column:
    """A string with a character for each part, that of its place in ``alphabet``, from U+10000 on."""
    code = lambda p: F.lpad(F.hex(F.array_position(alphabet, p) + 0xFFFF), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(parts, code), "")), "UTF-32")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two arrays of words: their distinct words, of which a million fit, become characters.

    The alphabet is bound as an element of an array; named in the inner lambdas
    themselves, it would be made anew for every word.
    """
    alphabets = F.array(F.array_distinct(F.concat(reference, hypothesis)))
    return F.get(F.transform(alphabets, lambda a: F.levenshtein(as_symbols(reference, a), as_symbols(hypothesis, a))), F.lit(0))


def word_error_rates(pairs: DataFrame) -> DataFrame:
    """(pair_id, wer) from (pair_id, reference, hypothesis); a null text has no words, and without reference words wer is null."""
    split = pairs.select("pair_id", words_of(F.col("reference")).alias("_r"), words_of(F.col("hypothesis")).alias("_h"))
    return split.select("pair_id", F.when(F.size("_r") > 0, word_distance(F.col("_r"), F.col("_h")) / F.size("_r")).alias("wer"))


def evaluation_report(results: DataFrame) -> DataFrame:
    """(recording_id, label, wer, cer, best): whether a setting has the recording's least error, null ones last; ties are all best."""
    least = F.min("wer").over(Window.partitionBy("recording_id"))
    return results.select("recording_id", "label", "wer", "cer", F.coalesce(F.col("wer") == least, F.lit(False)).alias("best"))


def validation_means(batches: DataFrame) -> DataFrame:
    """Mean of every measure (epoch, measure, value) over an epoch's batches; nulls don't count."""
    return batches.groupBy("epoch", "measure").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def first_items(items: DataFrame, n: int, *order: str) -> DataFrame:
    return items.orderBy(*order).limit(n)


def drawn_trials(items: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` items in a shuffled order that the seed fixes: those of the lowest hash, found as a top-k."""
    return items.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))).orderBy("_h").limit(n).drop("_h")


def merged_options(defaults: Column, given: Column) -> Column:
    """One map of both; what is given wins."""
    rest = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(rest, given)


def listening_verdicts(trials: DataFrame) -> DataFrame:
    """Accuracy per session and how audible the difference is, from (session, correct)."""
    accuracy = F.col("accuracy")
    verdict = F.when(accuracy >= 0.7, "audible").when(accuracy >= 0.55, "marginal").otherwise("inaudible")
    return trials.groupBy("session").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")).withColumn("verdict", verdict)


def frequency_deviation(bins: DataFrame, n_fft: int = 1024, hop: int = 256) -> DataFrame:
    """Mean magnitude-weighted phase deviation, from (batch, bin, frame_idx, phase, mag); bin 0 is left out."""
    w = Window.partitionBy("batch", "bin").orderBy("frame_idx")
    step = F.lead("phase").over(w) - F.col("phase") - F.col("bin") * (2 * math.pi * hop / n_fft)
    rows = bins.select("batch", "bin", step.alias("d"), F.lead("mag").over(w).alias("m"), F.max("mag").over(Window.partitionBy("batch")).alias("top"))
    dev = F.atan2(F.sin("d"), F.cos("d"))
    return rows.where("d is not null and bin >= 1").groupBy("batch").agg(F.avg(F.col("m") / F.col("top") * dev * dev).alias("loss"))


def validation_split(items: DataFrame, key: str, n_validation: int) -> DataFrame:
    """Mark ``n_validation`` items, those of the lowest hash, as validation.

    The cutoff is found by a top-k, not by sorting all items in one task.
    """
    hashed = items.withColumn("_h", F.md5(F.col(key).cast("string")))
    cut = hashed.select("_h").orderBy("_h").limit(n_validation).agg(F.max("_h").alias("_cut"))
    return hashed.crossJoin(F.broadcast(cut)).withColumn("is_validation", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))).drop("_h", "_cut")
