"""What is reported of groups: totals, filters, order, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.paths import VIDEO_SUFFIXES, base_name, has_suffix, parent, relative
from matchloom.functions.sizes import size_text
from matchloom.operators.keeper import exact_keep, scored, smart_defaults
from matchloom.operators.ranking import group_heads, group_order, group_ranks, numbered

#: Lists of up to so many group ids are broadcast.
BROADCAST_ROWS = 100_000


def summary(members: DataFrame) -> DataFrame:
    """One row: groups, files, recoverable (sizes of all but each group's first member)."""
    return members.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("files"), F.coalesce(F.sum(F.when(F.col("ordinal") > 0, F.col("size"))), F.lit(0)).alias("recoverable"))


def spread_at_least(members: DataFrame, delta) -> DataFrame:
    """Groups whose largest and smallest member differ by delta or more; all where delta isn't positive."""
    if delta <= 0:
        return members
    wide = members.groupBy("group_id").agg((F.max("size") - F.min("size")).alias("_d")).filter(F.col("_d") >= delta)
    return members.join(wide.select("group_id"), "group_id", "left_semi")


def _sources(members: DataFrame) -> list[str]:
    """Lists that union_sources() put one after the other stay in that order."""
    return ["source_ordinal"] if "source_ordinal" in members.columns else []


def _heads(members: DataFrame) -> DataFrame:
    """group_heads() by source: a group of one list isn't one of another of the same name."""
    more = _sources(members)
    return group_heads(members, more) if more else group_heads(members)


def first_groups(members: DataFrame, limit: int) -> DataFrame:
    """Members of the first `limit` groups: the best of each task's, then the best of those."""
    more = _sources(members)
    first = _heads(members).orderBy(*more, *group_order()).limit(limit).select("group_id", *more)
    return members.join(F.broadcast(first) if limit <= BROADCAST_ROWS else first, ["group_id", *more], "left_semi")


def ordered(members: DataFrame) -> DataFrame:
    """members with place: their group's from 0, source by source."""
    more = _sources(members)
    places = numbered(_heads(members), [*map(F.col, more), *group_order()]).select("group_id", *more, F.col("_n").alias("place"))
    return members.join(places, ["group_id", *more])


def pages(members: DataFrame, page_size: int) -> DataFrame:
    """group_id, rank, page from 0."""
    return group_ranks(members).select("group_id", "rank", F.floor((F.col("rank") - 1) / page_size).cast("long").alias("page"))


def review_order(members: DataFrame) -> DataFrame:
    """group_id, first_dir, place from 0: groups by the folder of their first member, within it by rank."""
    ranks = group_ranks(members).withColumn("first_dir", parent(F.col("first_path")))
    return numbered(ranks, [F.col("first_dir"), F.col("rank")]).select("group_id", "first_dir", F.col("_n").alias("place"))


def same_folder(members: DataFrame) -> DataFrame:
    """group_id, dirs, together: do all members share a folder?"""
    return members.groupBy("group_id").agg(F.countDistinct(parent(F.col("path"))).alias("dirs")).withColumn("together", F.col("dirs") == 1)


def union_sources(*groups: DataFrame) -> DataFrame:
    """Group lists one after the other: source_ordinal tells which."""
    out = [g.withColumn("source_ordinal", F.lit(k)) for k, g in enumerate(groups)]
    first = out[0]
    for g in out[1:]:
        first = first.unionByName(g)
    return first


def decorated(members: DataFrame, root: Column) -> DataFrame:
    """members (group_id, ordinal, path, size) with rel, name, dir, dir_rel, size_fmt, is_video."""
    path, folder = F.col("path"), parent(F.col("path"))
    return members.withColumns(
        {
            "rel": relative(path, root),
            "name": base_name(path),
            "dir": folder,
            "dir_rel": relative(folder, root),
            "size_fmt": F.trim(size_text(F.col("size"))),
            "is_video": has_suffix(path, VIDEO_SUFFIXES),
        }
    )


def groups_json(members: DataFrame, root: Column, extra: Sequence[str] = (), base: Column | None = None) -> DataFrame:
    """group_id, json: files in order as nested records, the default keeper and where a better name and folder come from."""
    fields = ("path", "rel", "name", "dir", "dir_rel", "size", "size_fmt", "is_video")
    one = F.struct("ordinal", F.struct(*fields).alias("f"))
    files = decorated(members, root).groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["f"]).alias("files"))
    both = files.join(smart_defaults(scored(members, extra, base)), "group_id")
    record = F.struct("files", F.col("keep").alias("keep_default"), "rename_src", "folder_src")
    return both.select("group_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def exact_report(members: DataFrame, extra: Sequence[str] = (), base: Column | None = None) -> DataFrame:
    """Rows to print, of groups of equal files: group_id, together (all in one folder), keep, final, path, kept, line from 0, the keeper last."""
    flags = same_folder(members).select("group_id", "together")
    out = members.join(exact_keep(scored(members, extra, base)), "group_id").join(flags, "group_id").withColumn("kept", F.col("path") == F.col("keep"))
    line = F.col("ordinal") - F.when(F.col("ordinal") > F.col("_at"), 1).otherwise(0)
    at = out.filter("kept").select("group_id", F.col("ordinal").alias("_at"))
    return out.join(at, "group_id").withColumn("line", F.when(F.col("kept"), F.col("group_size") - 1).otherwise(line)).select(
        "group_id", "together", "keep", "final", "path", "kept", F.col("line").cast("int").alias("line")
    )
