"""Is everything in the trash still somewhere else?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.paths import IMAGE_SUFFIXES, VIDEO_SUFFIXES, has_suffix
from matchloom.operators.similarity import near_hashes, video_pairs


def by_kind(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and videos among files (path)."""
    return files.filter(has_suffix(F.col("path"), IMAGE_SUFFIXES)), files.filter(has_suffix(F.col("path"), VIDEO_SUFFIXES))


def unmatched_images(trash: DataFrame, source: DataFrame, threshold: int) -> DataFrame:
    """Trash rows (path, phash, dhash) without any source row near them by both hashes."""
    near = near_hashes(trash, source, threshold).select(F.col("x_p").alias("phash"), F.col("x_d").alias("dhash")).distinct()
    return trash.join(near, ["phash", "dhash"], "left_anti").select(*trash.columns)


def unmatched_checksums(trash: DataFrame, source: DataFrame) -> DataFrame:
    return trash.join(source.select("checksum").distinct(), "checksum", "left_anti").select(*trash.columns)


def unmatched_videos(trash: DataFrame, source: DataFrame, threshold: float) -> DataFrame:
    """By checksum first; of the rest those without a perceptual match (path, duration, frames, checksum)."""
    rest = unmatched_checksums(trash, source)
    return rest.join(video_pairs(rest, source, threshold).selectExpr("a AS path").distinct(), "path", "left_anti").select(*trash.columns)


def verify_trash(images: tuple[DataFrame, DataFrame], videos: tuple[DataFrame, DataFrame], threshold: int, perceptual: bool = True) -> DataFrame:
    """path, kind, status of all files in the trash that have no match outside: unmatched, or unverifiable where reading failed.

    images: trash and source rows (path, phash, dhash); videos: trash and source rows (path, checksum, duration,
    frames). Rows that couldn't be read have null hashes or a null checksum. perceptual: compare videos that have no
    equal one by their frames; a video without frames is then judged by its checksum alone.
    """
    trash, source = images
    known = F.col("phash").isNotNull() & F.col("dhash").isNotNull()
    lost = unmatched_images(trash.filter(known), source, threshold).select("path", F.lit("unmatched").alias("status"))
    unread = trash.filter(~known).select("path", F.lit("unverifiable").alias("status"))
    trash_v, source_v = videos
    readable = trash_v.filter(F.col("checksum").isNotNull())
    rest = unmatched_videos(readable, source_v, threshold) if perceptual else unmatched_checksums(readable, source_v)
    lost_v = rest.select("path", F.lit("unmatched").alias("status"))
    unread_v = trash_v.filter(F.col("checksum").isNull()).select("path", F.lit("unverifiable").alias("status"))
    kind = lambda df, k: df.select("path", F.lit(k).alias("kind"), "status")
    return kind(lost.unionByName(unread), "image").unionByName(kind(lost_v.unionByName(unread_v), "video"))
