"""Cache maintenance as a stream: every micro-batch of inventory rows refreshes the Parquet cache by append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.cache import cache_status, last_rows
from matchloom.operators.materialize import cut
from matchloom.sources.caches import append_parquet


def refresh_stream(files: DataFrame, cache_path: str, schema: str, compute, checkpoint: str):
    """Starts a query that hashes what is new or changed. compute(path, size, mtime rows) gives cache rows; batches that come again add nothing.

    The cache may not exist yet: the first batch makes it.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = last_rows(spark.read.schema(f"{schema}, written long").parquet(cache_path), "written").drop("written")
        else:
            stored = spark.createDataFrame([], schema)
        seen = df.select("path", F.struct("mtime", "size").alias("f")).groupBy("path").agg(F.max("f").alias("f")).select("path", "f.size", "f.mtime")
        todo = cache_status(seen, stored).filter("status != 'hit'")
        done = cut(compute(todo.select("path", "size", "mtime")).withColumn("written", F.lit(epoch).cast("long")))  # read before it is added to
        append_parquet(done, cache_path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
