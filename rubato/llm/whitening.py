"""Whitening of embeddings by their principal components.

Entries become whole numbers first, so counts, sums and centred rows are exact
and do not depend on how the rows are dealt out.  The covariance is the Gramian
of the centred rows, summed by Spark's distributed ``RowMatrix``; only this
square of the dimension reaches the driver, is decomposed there, and goes out
again as a few directions with which every batch of rows is projected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

# An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from here on, infinities included, have no whole number that a double holds exactly.
LARGEST = 2.0**42
COMPONENTS = 8
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x): whole numbers of the rows whose vector is neither null nor empty and has finite entries below ``LARGEST`` only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    good = rows.select("vec_id", F.col(vector).alias(vector)).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return good.select("vec_id", F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT).alias("x"))


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of vectors of one length: a sum a task, then a row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                n, total = n + batch.num_rows, x.sum(axis=0) + (total if n else 0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.int64()))], ["n", "s"])

    parts = vectors.select("x").mapInArrow(run, "n long, s array<long>").select("n", F.posexplode("s").alias("i", "s"))
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by_dimension = {r["i"]: r for r in sums}
    return (by_dimension[0]["n"] if sums else 0), [by_dimension[i]["s"] for i in range(len(sums))]


def gramian(vectors: DataFrame, column: str, size: int) -> np.ndarray:
    """Sum of the outer products of an array column's rows with themselves."""
    as_vectors = vectors.select(array_to_vector(F.col(column)).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(as_vectors, "v"), numCols=size)
    return np.array(matrix.computeGramianMatrix().toArray())


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, directions as columns), falling; a variance within rounding of 0 counts as 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    nothing = max(values[0], 0) * len(covariance) * np.finfo(float).eps
    return np.where(values > nothing, values, 0.0), vectors


def identity_error(whitened: DataFrame, columns: np.ndarray, n: int) -> float:
    """Largest absolute entry of the covariance of some whitened columns minus the identity; 0 of no columns."""
    if not len(columns):
        return 0.0
    own = [F.get("whitened", F.lit(int(k))) for k in columns]
    means = whitened.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(own)]).first()
    centred = whitened.select(F.array(*[c - means[k] for k, c in enumerate(own)]).alias("c"))
    return float(np.abs(gramian(centred, "c", len(own)) / n - np.eye(len(own))).max())


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id and the columns of ``SCHEMA``): each row's place along every one of the first ``components`` directions.

    Rows of (vec_id, ``vector``); other columns are ignored.  Rows whose vector
    is null or empty or has a null or non-finite entry, or one of ``LARGEST``
    or more, are left out, and those of another length than the longest.  Every other row counts, repeated ones
    and those of a null vec_id as well; an empty table gives an empty result.
    A direction without variance, as of equal rows, has whitened values 0 and
    is left out of ``identity_error``.  ``deviation`` is null beyond a long.
    The sign of a direction is that of its entry of the greatest magnitude,
    made positive, so that reruns agree.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = whole_vectors(rows, vector)
    size = found.agg(F.max(F.size("x"))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    found = found.where(F.size("x") == size)
    n, sums = exact_sums(found)
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    centred = found.select("vec_id", F.zip_with("x", total, lambda x, s: x * n - s).alias("d"))  # n times the distance from the mean, exact
    distances = centred.select(F.transform("d", lambda v: v.cast("double") / n).alias("d"))
    covariance = gramian(distances, "d", size) / n
    variance, directions = principal_components(covariance, components)
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    scaled = spark.sparkContext.broadcast(directions / np.where(variance > 0, np.sqrt(variance), np.inf))  # the dimension times ``components``

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            distance = np.stack(frame["d"].to_numpy()).astype(float) / n if len(frame) else np.zeros((0, size))
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": frame["deviation"], "whitened": list(distance @ scaled.value)})

    square = F.aggregate("d", F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    projected = centred.select("vec_id", square.alias("deviation"), "d").mapInPandas(project, f"vec_id {kind}, deviation long, whitened array<double>")
    whitened = materialise(projected, "whitened")
    explained = variance / max(np.trace(covariance), np.finfo(float).tiny)
    error = identity_error(whitened, np.flatnonzero(variance), n)
    shares = F.array(*[F.lit(float(v)) for v in explained])
    each = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
