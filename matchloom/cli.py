"""Command line: groups of duplicates in a folder, or what of its trash has no match left."""

from __future__ import annotations

import argparse
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.paths import IMAGE_SUFFIXES, MEDIA_SUFFIXES, TRASH, VIDEO_SUFFIXES, shown
from matchloom.functions.sizes import parse_size, size_text
from matchloom.operators import actions, cluster, interactive, report, verify
from matchloom.operators.materialize import cut
from matchloom.sources import caches, media
from matchloom.sources.scan import scan_files


def arguments(argv=None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="matchloom", description=__doc__)
    p.add_argument("folder")
    p.add_argument("--exact", action="store_true", help="by checksum instead of by look; images and videos")
    p.add_argument("--video", action="store_true", help="videos too, by their frames (needs ffmpeg); ignored with --exact")
    p.add_argument("--threshold", "-t", type=int, default=10, help="bits that may differ; ignored with --exact")
    p.add_argument("--cache", "-c", help="folder of the caches; by default one in the scanned folder")
    p.add_argument("--delta", "-d", default="0", help="least difference of sizes in a group; ignored with --exact, where sizes are equal")
    p.add_argument("--limit", "-l", type=int)
    p.add_argument("--ignore", "-i", action="append", default=[], metavar="WORD", help="a word that says nothing in names and folders; may be repeated")
    p.add_argument("--page-size", "-p", type=int, default=10)
    p.add_argument("--choices", metavar="CSV", help="group_id,letter: which folder of a group stays; prints the plan")
    p.add_argument("--apply", action="store_true", help="carry the plan of --choices out")
    kind = p.add_mutually_exclusive_group()
    kind.add_argument("--review", action="store_true", help="groups as JSON lines, in pages, with default decisions")
    kind.add_argument("--interactive", action="store_true", help="what there is to choose from, by group, for --choices")
    p.add_argument("--verify-trash", action="store_true")
    a = p.parse_args(argv)
    if not os.path.isdir(a.folder):
        p.error("no such folder")
    if a.threshold < 0 or (a.limit is not None and a.limit < 1):
        p.error("threshold must be 0 or more, limit 1 or more")
    if not 1 <= a.page_size <= 500:
        p.error("page size must be from 1 to 500")
    if a.cache and os.path.exists(a.cache) and not os.path.isdir(a.cache):
        p.error("the cache must be a folder")
    try:
        a.delta = parse_size(a.delta)
    except ValueError as e:
        p.error(str(e))
    a.folder = os.path.abspath(a.folder)
    a.cache = a.cache and os.path.abspath(a.cache)
    return a


def _said(what: str, n: dict[str, int]) -> None:
    print(f"{what}: " + ", ".join(f"{k} {v}" for k, v in n.items()))


def image_hashes(files: DataFrame, store: str) -> tuple[DataFrame, dict[str, int]]:
    """path, size, mtime, phash, dhash of readable images, by way of the cache in `store`."""
    links = os.path.join(store, f"links-{uuid.uuid4().hex}")
    try:
        n = caches.update_store(files, store, caches.IMAGES, lambda todo: media.hash_image_files(todo, os.path.join(links, uuid.uuid4().hex)))
    finally:
        _remove_links(links)
    return caches.read_store(files.sparkSession, store, caches.IMAGES), n


def _remove_links(folder: str) -> None:
    for at, dirs, names in os.walk(folder, topdown=False):
        for name in names:
            os.unlink(os.path.join(at, name))
        for name in dirs:
            os.rmdir(os.path.join(at, name))
    if os.path.isdir(folder):
        os.rmdir(folder)


def video_hashes(files: DataFrame, store: str, keep_missing: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """path, size, mtime, duration, frames of readable videos. Videos are slow to read, so chunks are small."""
    n = caches.update_store(files, store, caches.VIDEOS, media.hash_videos, chunk=200, keep_missing=keep_missing)
    return caches.read_store(files.sparkSession, store, caches.VIDEOS), n


def checksums(files: DataFrame, store: str, keep_missing: bool = False) -> tuple[DataFrame, dict[str, int]]:
    n = caches.update_store(files, store, caches.CHECKSUMS, media.checksums, keep_missing=keep_missing)
    return caches.read_store(files.sparkSession, store, caches.CHECKSUMS), n


def trash_report(spark: SparkSession, folder: str, threshold: int, cache: str | None = None, perceptual: bool | None = None) -> DataFrame:
    """path, kind, status of files in the folder's trash that have no match in the folder, or can't be read.

    perceptual: compare videos by their frames (None: if ffmpeg is there). Caches of the trash are in the trash;
    those of the folder keep rows of files that aren't looked at here.
    """
    perceptual = media.ffmpeg_available() if perceptual is None else perceptual
    trash = os.path.join(folder, TRASH)
    mine, theirs = caches.database_dir(folder, cache), caches.database_dir(trash)
    inside, outside = verify.by_kind(scan_files(spark, trash, MEDIA_SUFFIXES)), verify.by_kind(scan_files(spark, folder, MEDIA_SUFFIXES))
    every = lambda files, prints: files.select("path").join(prints.drop("size", "mtime"), "path", "left")
    images = every(inside[0], image_hashes(inside[0], theirs)[0]), image_hashes(outside[0], mine)[0]
    sums = every(inside[1], checksums(inside[1], theirs)[0]), every(outside[1], checksums(outside[1], mine, keep_missing=True)[0])
    if perceptual:
        rest = cut(verify.unmatched_checksums(sums[0].filter("checksum is not null"), sums[1]))
        if rest.limit(1).count():
            open_ = inside[1].join(rest.select("path"), "path", "left_semi")
            frames = video_hashes(open_, theirs, keep_missing=True)[0], video_hashes(outside[1], mine, keep_missing=True)[0]
        else:
            frames = (spark.createDataFrame([], caches.VIDEOS.schema),) * 2
        videos = tuple(s.join(f.select("path", "duration", "frames"), "path", "left") for s, f in zip(sums, frames, strict=True))
    else:
        videos = sums
    return verify.verify_trash(images, videos, threshold, perceptual)


def find_groups(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Ranked members of all groups asked for: group_id, path, size, ordinal, group_size, source_ordinal."""
    store = caches.database_dir(a.folder, a.cache)
    if a.exact:
        sums, n = checksums(scan_files(spark, a.folder, MEDIA_SUFFIXES), store)
        _said("checksums", n)
        return report.union_sources(cluster.exact_groups(sums))
    hashes, n = image_hashes(scan_files(spark, a.folder, IMAGE_SUFFIXES), store)
    _said("images", n)
    groups = [cluster.leader_groups(hashes, a.threshold)]
    if a.video and not media.ffmpeg_available():
        print("warning: no ffmpeg, videos are left out", file=sys.stderr)
    elif a.video:
        videos, n = video_hashes(scan_files(spark, a.folder, VIDEO_SUFFIXES), store)
        _said("videos", n)
        groups.append(cluster.video_groups(videos, a.threshold))
    return report.spread_at_least(report.union_sources(*groups), a.delta)


def print_groups(groups: DataFrame, a: argparse.Namespace) -> None:
    """Members group by group, streamed to the driver; of equal files what to keep and under which name."""
    s = report.summary(groups)
    s = s.select("groups", "files", F.trim(size_text(F.col("recoverable"))).alias("free")).first()
    print(f"groups {s.groups}, files {s.files}, recoverable {s.free}")
    order = report.ordered(groups)
    if not a.exact:
        for r in order.orderBy("place", "ordinal").toLocalIterator():
            print(f"{r.place}\t{r.ordinal}\t{r.size}\t{r.path}" + ("\tlargest" if r.ordinal == 0 else ""))
        return
    lines = report.exact_report(groups, a.ignore, F.lit(a.folder)).join(order.select("group_id", "place").distinct(), "group_id")
    for r in lines.orderBy("together", "place", "line").toLocalIterator():
        final = f"\t-> {r.final}" if r.kept and os.path.normpath(r.final) != r.path else ""
        print(f"{r.place}\t{'keep' if r.kept else 'remove'}\t{r.path}{final}" + ("\tsame folder" if r.together else ""))


def choices_plan(groups: DataFrame, choices: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Phase by phase, what choices (group_id, letter) come to: moves to the trash, then new names."""
    spark = groups.sparkSession
    root = F.lit(a.folder)
    decided = cut(interactive.decide(groups, choices, root, a.ignore))
    there = scan_files(spark, a.folder, MEDIA_SUFFIXES).unionByName(scan_files(spark, os.path.join(a.folder, TRASH), MEDIA_SUFFIXES)) if os.path.isdir(os.path.join(a.folder, TRASH)) else scan_files(spark, a.folder, MEDIA_SUFFIXES)
    trash = actions.unique_targets(decided.filter("action = 'trash'").selectExpr("path AS src", "dst"), there.select("path"))
    names = decided.filter("action = 'rename'").selectExpr("2 AS phase", "path AS src", "dst", "'ok' AS status")
    return trash.selectExpr("1 AS phase", "src", "dst", "'ok' AS status").unionByName(names)


def main(argv=None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    if a.verify_trash:
        if not os.path.isdir(os.path.join(a.folder, TRASH)):
            print("no trash")
            return 0
        rest = trash_report(spark, a.folder, a.threshold, a.cache)
        lost = 0
        for r in rest.orderBy("path").withColumn("path", shown(F.col("path"), os.name == "nt")).toLocalIterator():
            print(f"{r.status}\t{r.kind}\t{r.path}")
            lost += 1
        print(f"without a match: {lost}" if lost else "all matched")
        return int(bool(lost))
    groups = cut(find_groups(spark, a))
    if a.limit:
        groups = cut(report.first_groups(groups, a.limit))
    if a.choices:
        plan = cut(choices_plan(groups, spark.read.option("header", True).csv(a.choices), a))
        for r in plan.orderBy("phase", "src").toLocalIterator():
            print(f"{'trash' if r.phase == 1 else 'rename'}\t{r.src}\t{r.dst}")
        _said("done" if a.apply else "would do", actions.carry_out(plan, not a.apply, a.folder))
    elif a.review:
        order = report.review_order(groups).select("group_id", "place")
        both = report.groups_json(groups, F.lit(a.folder), a.ignore, F.lit(a.folder)).join(order, "group_id").orderBy("place")
        for r in both.toLocalIterator():
            print(f"{r.place // a.page_size}\t{r.group_id}\t{r.json}")
    elif a.interactive:
        order = interactive.interactive_order(groups).select("group_id", "place")
        for r in interactive.offered(groups).join(order, "group_id").orderBy("place", "choice").toLocalIterator():
            print(f"{r.place}\t{r.group_id}\t{r.letter}\t{r.dir}")
    else:
        print_groups(groups, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
