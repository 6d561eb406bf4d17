"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import arrow_limits, partitions, table, work_path
from matchloom.llm.tokens import encoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Rows of a row group, which the index and the Bloom filter let a reader skip.
ROWS_A_GROUP = 1000
STRIPE_BYTES = 16 << 20
END_ID = 0


def _encode(path: str | None, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, part, start = encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, len(ids), 256):
                raw = [r + end for r in enc.encode(texts[low : low + 256].to_pylist())]
                n = np.array([len(r) >> 2 for r in raw], np.int64)
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(raw), part, np.int32)), ids[low : low + 256], pa.array(start + ends - n), pa.array(n), lists],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def _borders_below(key: Column, borders: list[int]) -> Column:
    """The number of sorted borders at or below a key, found by halving in a literal array; 0 for a null key."""
    if not borders:
        return F.lit(0)
    edges = F.array(*map(F.lit, borders))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= key, at + step).otherwise(at))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> None:
    """Encode every whole text and write its ids, with end_id appended, as ORC in ascending id order.

    Files are ranges of ids: part k holds smaller ids than part k + 1, each sorted within. The borders come
    from a scan of the id column alone, so texts are read once and shuffled once. Rows: part, doc_id,
    local_start (ids in this part before the document), n_tokens, ids. Integers are run-length encoded;
    row groups carry minima, maxima and a Bloom filter of doc_id.

    Null texts are empty (the end id alone); null ids come first; rows with equal ids stay together, in any
    order. An empty table gives a folder with a schema and no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    n = files or partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    borders = slim.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("b")).first().b if n > 1 else []
    borders = sorted(set(borders or []))  # as many as there are files
    ranged = slim.repartitionById(len(borders) + 1, _borders_below(F.col("doc_id"), borders)).sortWithinPartitions("doc_id")
    (
        ranged.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("orc.compress", "ZSTD")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROWS_A_GROUP))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.encoding.strategy", "SPEED")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: list[int] | None = None) -> DataFrame:
    """The rows of write_tokens; with bounds, only stripes and row groups that may hold ids from first to last are read.

    ids: these documents alone; row groups are left out by their Bloom filters too.
    """
    df = spark.read.schema(SCHEMA).orc(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= first)
    if ids is not None:
        df = df.filter(F.col("doc_id").isin(*ids))
    return df if last is None else df.filter(F.col("doc_id") <= last)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, part_start: ids in all parts before. One row for each file, from two columns."""
    sums = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("part_start"))


def _crc(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(3)
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        view = memoryview(np.ascontiguousarray(flat)).cast("B")
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64()), pa.array(np.diff(offsets).astype(np.int64))], ["part", "doc_id", "local_start", "ids_crc32", "n_tokens"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    arrow_limits(spark)
    rows = read_tokens(spark, path).select("part", "doc_id", "local_start", "ids")
    rows = rows.mapInArrow(_crc, "part int, doc_id long, local_start long, ids_crc32 long, n_tokens long")
    # one row for each file written: as many as write_tokens had partitions
    return rows.join(F.broadcast(part_starts(spark, path)), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_orc(spark, sf_dir: str) -> DataFrame:
    path = work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
