"""Helpers shared by the text-corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.  The
#: same six characters are what ``bytes.split()`` splits on.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A key with more than one row in so many is hot; there are fewer of them than this.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``.  Only where that is unset
    and Spark runs on this machine alone, as in local tests, a temporary folder
    of this machine is used; on a cluster that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Parquet rather than ``checkpoint()`` so that later readers prune columns;
    the files outlive any executor.  They stay until ``discard`` or until the
    folder is cleared, as results are lazy and may read them at any later time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._materialised = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._materialised)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def join_on_key(rows: DataFrame, known: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``rows`` with the columns of ``known``, which has a row per ``key`` and ``_n``, how many of ``rows`` have it.

    A key that holds more than one row in ``HOT_SHARE`` does not go through
    the shuffle: there are fewer than ``HOT_SHARE`` such keys, whatever the
    size of the tables, so theirs are broadcast.  ``fold`` is what is to be
    done to all rows of a key, such as a sum; it is applied to hot keys and to
    the others apart, so that the latter are dealt out once.  ``known`` has to
    be materialised; its keys are not null.
    """
    total, most = known.agg(F.sum("_n"), F.max("_n")).first()
    rest = known.drop("_n")
    if (total or 0) < HOT_SHARE or most * HOT_SHARE <= total:
        return fold(rows.join(rest, key))
    hot = known.where(F.col("_n") * HOT_SHARE > total)
    by_value = rows.join(F.broadcast(hot.drop("_n")), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return fold(by_value).unionByName(fold(cold))


#: Rows with their texts that a task sends back to Spark at a time; a whole batch of them takes that much memory again on either side.
ROWS_SENT_BACK = 256


def sent_back(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of ``ROWS_SENT_BACK`` rows."""
    for lo in range(0, batch.num_rows, ROWS_SENT_BACK):
        yield batch.slice(lo, ROWS_SENT_BACK)


def column_of(batch: pa.RecordBatch, path: tuple[str, ...]) -> pa.Array:
    """A column, or a field of a struct column, which then need not be sent beside the struct."""
    found = batch.column(path[0])
    return pc.struct_field(found, list(path[1:])) if len(path) > 1 else found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
