"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.materialize import delete_path, shared_dir

#: The characters of [\x20\x09-\x0D], which separate words everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"

#: Of N rows at most HOT_SHARE keys can hold N / HOT_SHARE rows or more: the bound of hot-key broadcasts.
HOT_SHARE = 512

#: Dimension tables of up to so many narrow rows are broadcast after counting them; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/matchloom/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that no result reads any more."""
    delete_path(df.sparkSession, df._staged_at.rsplit("/", 1)[0])


def clean_up(spark: SparkSession) -> None:
    """Deletes all staged tables in the shared folder; for when no result of this subpackage is read any more."""
    delete_path(spark, f"{shared_dir(spark)}/matchloom")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes: one batch of long texts must not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read_limits(spark: SparkSession) -> None:
    """Decode few rows of a Parquet file at once: Spark's usual 4096 whole texts are one array, doubled as it grows."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def give_back() -> None:
    """Returns a worker's freed memory to the system: it lives on beside the JVM, which needs it for other stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: what splits labelled rows into training and held-out ones."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted, not guessed); else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def join_skewed(rows: DataFrame, dim: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Left join of rows with a dimension unique in `on`, whose column `weight` counts the rows of each key.

    Keys that hold total / HOT_SHARE rows or more go by broadcast (HOT_SHARE of them at most, whatever
    the data), so their rows aren't shuffled; the rest meets in a shuffled join without hot keys.
    """
    hot_from = max(total // HOT_SHARE, 1000)
    hot, cold = dim.filter(F.col(weight) >= hot_from), dim.filter(F.col(weight) < hot_from)
    names = [c for c in dim.columns if c not in on]
    left = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    by_hot = left.filter(F.col("_hot").isNotNull()).drop("_hot")
    by_cold = left.filter(F.col("_hot").isNull()).drop("_hot", *names).join(cold, on, "left")
    return by_hot.select(*by_cold.columns).unionByName(by_cold)
