"""Fingerprint caches: CSV files with rows that can't be trusted left out, and Parquet tables that grow chunk by chunk."""

from __future__ import annotations

import math
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.hashing import bits_to_hex, hex_to_bits
from matchloom.functions.paths import DATABASES
from matchloom.operators.cache import cache_status, last_rows, prune, pruned
from matchloom.operators.materialize import cut

# The columns of the CSV files, and their names.
IMAGE = ("path", "size", "mtime", "phash", "dhash")
VIDEO = ("path", "size", "mtime", "duration", "vhash")
CHECKSUM = ("path", "size", "ctime", "mtime", "checksum")
IMAGE_CSV = "images_perceptual_hash_db.csv"
VIDEO_CSV = "videos_perceptual_hash_db.csv"
CHECKSUM_CSV = "all_media_sha_hash_db.csv"

#: Files that are hashed between two commits of a Parquet cache: what an interrupted run loses at most.
CHUNK = 10_000


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Strings by the names in the header; columns that it lacks are empty. Rows carry their place in the file, _row."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    have = raw.select(*[F.col(f"`{c}`") if c in raw.columns else F.lit("").alias(c) for c in columns])
    return have.withColumn("_row", F.monotonically_increasing_id())  # one file is one partition: multiLine isn't split


def _last(rows: DataFrame) -> DataFrame:
    return last_rows(rows, "_row").drop("_row")


def _number(name: str, kind: str) -> Column:
    return F.col(name).try_cast(kind).alias(name)


def clean_images(raw: DataFrame) -> DataFrame:
    """path, size, mtime, phash, dhash as numbers; rows with a bad number or hash are left out, an empty dhash is null."""
    rest = [c for c in raw.columns if c not in IMAGE]
    none = (F.coalesce(F.length("dhash"), F.lit(0)) == 0).alias("_no")
    out = raw.select("path", _number("size", "bigint"), _number("mtime", "double"), hex_to_bits(F.col("phash")).alias("phash"), hex_to_bits(F.col("dhash")).alias("dhash"), none, *rest)
    return out.filter(F.col("size").isNotNull() & F.col("mtime").isNotNull() & F.col("phash").isNotNull() & (F.col("_no") | F.col("dhash").isNotNull())).drop("_no")


def clean_videos(raw: DataFrame) -> DataFrame:
    """path, size, mtime, duration, frames; rows with a bad number, no frame or one that isn't hex are left out."""
    rest = [c for c in raw.columns if c not in VIDEO]
    frames = F.transform(F.split("vhash", ","), hex_to_bits)
    out = raw.select("path", _number("size", "bigint"), _number("mtime", "double"), _number("duration", "double"), frames.alias("frames"), *rest)
    return out.filter(F.col("size").isNotNull() & F.col("mtime").isNotNull() & F.col("duration").isNotNull() & F.forall("frames", lambda x: x.isNotNull()) & (F.size("frames") > 0))


def clean_checksums(raw: DataFrame) -> DataFrame:
    rest = [c for c in raw.columns if c not in CHECKSUM]
    out = raw.select("path", _number("size", "bigint"), _number("ctime", "double"), _number("mtime", "double"), "checksum", *rest)
    return out.filter(F.col("size").isNotNull() & F.col("ctime").isNotNull() & F.col("mtime").isNotNull() & F.col("checksum").rlike("^[0-9a-f]{64}$"))


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Of several good rows of a path the last one."""
    return _last(clean_images(_csv(spark, path, IMAGE)))


def load_videos(spark: SparkSession, path: str) -> DataFrame:
    return _last(clean_videos(_csv(spark, path, VIDEO)))


def load_checksums(spark: SparkSession, path: str) -> DataFrame:
    return _last(clean_checksums(_csv(spark, path, CHECKSUM)))


def export_csv(cache: DataFrame, path: str) -> None:
    """A cache as one CSV file sorted by path, hashes as hex, put in the old one's place in one step."""
    out = cache
    for c in ("phash", "dhash"):
        if c in cache.columns:
            out = out.withColumn(c, bits_to_hex(F.col(c)))
    if "frames" in cache.columns:
        out = out.withColumn("vhash", F.array_join(F.transform("frames", bits_to_hex), ",")).drop("frames")
    order = next(k for k in (IMAGE, VIDEO, CHECKSUM) if set(k) <= set(out.columns))
    beside = f"{path}.{uuid.uuid4().hex}"
    out.select(*order).orderBy("path").coalesce(1).write.option("header", True).option("escape", '"').csv(beside)
    fs, at = _files(cache.sparkSession, beside)
    try:
        parts = [s.getPath() for s in fs.listStatus(at(beside)) if s.getPath().getName().startswith("part-")]
        if not parts:  # no rows, no part
            fs.create(at(f"{beside}/part-0"), True).close()
            with_header = (",".join(order) + "\n").encode()
            stream = fs.create(at(f"{beside}/part-0"), True)
            stream.write(bytearray(with_header))
            stream.close()
            parts = [at(f"{beside}/part-0")]
        _replace(fs, parts[0], at(path))
    finally:
        fs.delete(at(beside), True)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _replace(fs, new, old) -> None:
    """Puts new in the place of old. The old one stays beside until the new one is there, and comes back if that fails."""
    aside = old.suffix(f".{uuid.uuid4().hex}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"can't move {old} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"can't rename {new}")
    if had:
        fs.delete(aside, True)


def replace_parquet(cache: DataFrame, path: str) -> None:
    """Writes beside the old table, then renames: a failure leaves the old one, or a copy of it named *.old."""
    beside = f"{path}.{uuid.uuid4().hex}"
    fs, at = _files(cache.sparkSession, path)
    try:
        cache.write.parquet(beside)
        _replace(fs, at(beside), at(path))
    finally:
        fs.delete(at(beside), True)


def append_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@dataclass(frozen=True)
class Kind:
    """A kind of cache: its Parquet table's name and columns, and the CSV file it starts from where there is one."""

    table: str
    schema: str
    csv: str
    load: object


IMAGES = Kind("images.parquet", "path string, size long, mtime double, phash long, dhash long", IMAGE_CSV, load_images)
VIDEOS = Kind("videos.parquet", "path string, size long, mtime double, duration double, frames array<long>", VIDEO_CSV, load_videos)
CHECKSUMS = Kind("checksums.parquet", "path string, size long, mtime double, checksum string", CHECKSUM_CSV, load_checksums)


def database_dir(folder: str, cache: str | None = None) -> str:
    """Where a folder's caches are, made if it isn't there."""
    out = cache or os.path.join(folder, DATABASES)
    os.makedirs(out, exist_ok=True)
    return out


def read_store(spark: SparkSession, folder: str, kind: Kind) -> DataFrame:
    """The cache in a folder: of each path the row written last; empty where there is none yet."""
    path, old = os.path.join(folder, kind.table), os.path.join(folder, kind.csv)
    fs, at = _files(spark, path)
    names = [c.split()[0] for c in kind.schema.split(", ")]
    if fs.exists(at(path)):
        return last_rows(spark.read.schema(f"{kind.schema}, written long").parquet(path), "written").select(*names)
    if fs.exists(at(old)):
        return kind.load(spark, old).select(*names)
    return spark.createDataFrame([], kind.schema)


def update_store(files: DataFrame, folder: str, kind: Kind, compute, chunk: int = CHUNK, keep_missing: bool = False) -> dict[str, int]:
    """Hashes what is new or changed and commits it chunk by chunk, then compacts the table; counts by outcome.

    files: path, size, mtime. compute(rows of these) gives the kind's columns and error, which is null for rows that
    are stored. An interrupted run loses one chunk. keep_missing: rows of paths that aren't in files stay.
    """
    spark = files.sparkSession
    path = os.path.join(folder, kind.table)
    names = [c.split()[0] for c in kind.schema.split(", ")]
    files = cut(files.select("path", "size", "mtime"))
    cache = cut(read_store(spark, folder, kind))
    status = cut(cache_status(files, cache).select("path", "size", "mtime", "status"))
    if not _files(spark, path)[0].exists(_files(spark, path)[1](path)):
        append_parquet(cache.withColumn("written", F.lit(0).cast("long")), path)
    todo = status.filter("status != 'hit'").select("path", "size", "mtime")
    chunks, errors = math.ceil(todo.count() / chunk), 0
    for k in range(chunks):
        done = cut(compute(todo.filter(F.pmod(F.xxhash64("path"), F.lit(chunks)) == k)).select(*names, "error"))
        append_parquet(done.filter("error is null").select(*names).withColumn("written", F.lit(time.time_ns())), path)
        errors += done.filter("error is not null").count()
    now = cut(read_store(spark, folder, kind))
    gone = pruned(now, files).count()
    replace_parquet((now if keep_missing else prune(now, files)).withColumn("written", F.lit(0).cast("long")), path)
    n = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
    return {"files": sum(n.values()), "hits": n.get("hit", 0), "new": n.get("new", 0), "rehashed": n.get("stale", 0) + n.get("unknown", 0), "errors": errors, "pruned": 0 if keep_missing else gone}
