"""The fingerprint cache: freshness, pruning, counters, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds; a difference of this much is a change.
TOLERANCE = 2.0


def cache_status(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, size, mtime) with the cache row's other columns and status: hit, new, stale, or unknown (a file whose size or time couldn't be read).

    A cached row with a null fingerprint is no hit: its file is read again. cache: one row a path.
    """
    prints = [c for c in cache.columns if c not in ("path", "size", "mtime")]
    found = cache.withColumn("_in", F.lit(True)).withColumnsRenamed({"size": "_size", "mtime": "_mtime"})
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in prints], F.lit(True))
    fresh = (F.col("size") == F.col("_size")) & (F.abs(F.col("mtime") - F.col("_mtime")) < TOLERANCE) & whole
    unknown = F.col("size").isNull() | F.col("mtime").isNull()
    return (
        files.join(found, "path", "left")
        .withColumn("status", F.when(unknown, "unknown").when(F.col("_in").isNull(), "new").when(fresh, "hit").otherwise("stale"))
        .drop("_in", "_size", "_mtime")
    )


def prune(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows of paths that still exist."""
    return cache.join(files.select("path").distinct(), "path", "left_semi")


def pruned(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows of paths that are gone."""
    return cache.join(files.select("path").distinct(), "path", "left_anti")


def last_rows(cache: DataFrame, written: str) -> DataFrame:
    """Of several rows of a path the one written last; of equal times any one, the same in every run."""
    rest = [c for c in cache.columns if c != "path"]
    order = F.struct(written, F.xxhash64(*[c for c in rest if c != written]))
    return cache.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("r")).select("path", "r.*")


def counters(status: DataFrame, failed: DataFrame | None = None, gone: DataFrame | None = None) -> DataFrame:
    """One row: files, hits, new, rehashed; with failed and gone rows (path) also errors and pruned."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = status.agg(F.count("*").alias("files"), n("hit").alias("hits"), n("new").alias("new"), n("stale", "unknown").alias("rehashed"))
    for name, rows in (("errors", failed), ("pruned", gone)):
        if rows is not None:
            out = out.crossJoin(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row beside one row
    return out


def refresh(files: DataFrame, cache: DataFrame, compute, keep_missing: bool = False) -> DataFrame:
    """The cache after a run: fresh rows as they are, compute(rows to hash) for the rest; rows of missing paths go unless kept.

    Old rows of files whose size or time couldn't be read stay if compute gives none.
    """
    status = cache_status(files, cache)
    hits = status.filter("status = 'hit'").select(*cache.columns)
    done = compute(status.filter("status != 'hit'").select("path", "size", "mtime")).select(*cache.columns)
    unread = status.filter("status = 'unknown'").select("path")
    old = cache.join(unread, "path", "left_semi").join(done.select("path"), "path", "left_anti")
    out = hits.unionByName(done).unionByName(old)
    return out.unionByName(pruned(cache, files)) if keep_missing else out


def on_disk(rows: DataFrame, inventory: DataFrame, windows: bool = False) -> DataFrame:
    """rows (path, a cache's key) with place: the path that the inventory (path) has for the key, or the key itself."""
    from matchloom.functions.paths import without_drive

    known = inventory.select(without_drive(F.col("path"), windows).alias("_key"), F.col("path").alias("place"))
    out = rows.join(known, F.col("path") == F.col("_key"), "left").drop("_key") if windows else rows.withColumn("place", F.col("path"))
    return out.withColumn("place", F.coalesce("place", "path"))
