"""Stepwise review as a batch: what is offered for every group, and what a table of choices comes to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions.paths import TRASH, base_name, parent, trash_path
from matchloom.operators.keeper import scored, smart_defaults
from matchloom.operators.ranking import numbered

#: Folders that can be chosen, one for each letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def best_names(scored_members: DataFrame) -> DataFrame:
    """group_id, best_name: the first name of the greatest score."""
    return scored_members.groupBy("group_id").agg(F.max_by("name", F.struct("name_score", -F.col("ordinal"))).alias("best_name"))


def folder_choices(members: DataFrame) -> DataFrame:
    """group_id, dir, choice from 0: a group's folders in the order in which they are first seen."""
    dirs = members.groupBy("group_id", parent(F.col("path")).alias("dir")).agg(F.min("ordinal").alias("_first"))
    return dirs.withColumn("choice", F.row_number().over(W.partitionBy("group_id").orderBy("_first")) - 1).select("group_id", "dir", "choice")


def offered(members: DataFrame) -> DataFrame:
    """folder_choices() that can be made, with their letter: the first 26."""
    letters = F.array(*map(F.lit, LETTERS))
    return folder_choices(members).filter(F.col("choice") < len(LETTERS)).withColumn("letter", F.element_at(letters, F.col("choice") + 1))


def interactive_order(members: DataFrame) -> DataFrame:
    """group_id, first_dir, names, place from 0: groups by their least folder, then by their names in it."""
    rows = members.select("group_id", parent(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"))
    least = rows.groupBy("group_id").agg(F.min("dir").alias("dir"))
    keys = rows.join(least, ["group_id", "dir"]).groupBy("group_id", F.col("dir").alias("first_dir")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return numbered(keys, [F.col("first_dir"), F.col("names"), F.col("group_id")]).select("group_id", "first_dir", "names", F.col("_n").alias("place"))


def decide(members: DataFrame, choices: DataFrame, root: Column, extra: Sequence[str] = (), base: Column | None = None) -> DataFrame:
    """What choices (group_id, letter) come to: group_id, path, action, dst.

    Actions: skip (no choice, or an unknown letter), refused (more folders than letters, where files could be lost
    that can't be chosen), trash, keep, rename. In the folder chosen, the greatest (folder score, name score) stays, the
    first of equals; it gets the group's best name where that is another. dst is a wish: whether a name is free
    shows when plans are made (actions.unique_targets) and carried out.
    """
    base = root if base is None else base
    rows = scored(members, extra, base)
    dirs = folder_choices(members)
    many = dirs.groupBy("group_id").agg((F.count("*") > len(LETTERS)).alias("_many"))
    picked = offered(members).join(choices.select("group_id", "letter").distinct(), ["group_id", "letter"]).select("group_id", F.col("dir").alias("_dir"))
    out = rows.join(many, "group_id").join(picked, "group_id", "left").join(best_names(rows), "group_id")
    inside = out.filter(F.col("dir") == F.col("_dir")).groupBy("group_id").agg(F.max_by("path", F.struct("folder_score", "name_score", -F.col("ordinal"))).alias("_keep"))
    out = out.join(inside, "group_id", "left")
    flat = F.concat(root, F.lit(f"/{TRASH}/"), base_name(F.col("path")))
    action = (
        F.when(F.col("_dir").isNull(), "skip")
        .when(F.col("_many"), "refused")
        .when(F.col("path") != F.col("_keep"), "trash")
        .when(F.col("name") != F.col("best_name"), "rename")
        .otherwise("keep")
    )
    dst = F.when(F.col("action") == "trash", F.coalesce(trash_path(F.col("path"), root), flat)).when(F.col("action") == "rename", F.concat_ws("/", "dir", "best_name"))
    return out.withColumn("action", action).select("group_id", "path", "action", dst.alias("dst"))


def default_decision(members: DataFrame, extra: Sequence[str] = (), base: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """keep (path) and sources (group_id, rename_src, folder_src) as a review starts: the first member of each group stays."""
    chosen = smart_defaults(scored(members, extra, base))
    return chosen.select(F.col("keep").alias("path")), chosen.select("group_id", "rename_src", "folder_src")


def transform_requests(members: DataFrame, keep: DataFrame, sources: DataFrame) -> DataFrame:
    """path, new_name, target_dir: what selections in a review ask of kept files, for actions.transform_plan().

    Only groups of which exactly one file is kept ask for anything: the name of rename_src and the folder of
    folder_src, members of the group that aren't kept themselves.
    """
    kept = members.join(keep.select("path").distinct(), "path", "left_semi").select("group_id", "path").distinct()
    single = kept.groupBy("group_id").agg(F.count("*").alias("_n"), F.min("path").alias("path")).filter("_n = 1").drop("_n")
    inside = members.select("group_id", F.col("path").alias("_m")).distinct()

    def source(column: str, alias: str, value: Column) -> DataFrame:
        asked = sources.select("group_id", F.col(column).alias("_m")).filter("_m is not null")
        return asked.join(inside, ["group_id", "_m"]).join(kept.withColumnRenamed("path", "_m"), ["group_id", "_m"], "left_anti").select("group_id", value.alias(alias))

    out = single.join(source("rename_src", "new_name", base_name(F.col("_m"))), "group_id", "left").join(source("folder_src", "target_dir", parent(F.col("_m"))), "group_id", "left")
    return out.filter("new_name is not null or target_dir is not null").select("path", "new_name", "target_dir")


def decisions_from_json(rows: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """keep (path) and requests (path, new_name, target_dir) of decisions {"keep": [...], "renames": [{...}]}.

    What isn't a string is dropped, and so are requests without a path; a text that is no such object says nothing.
    """
    whole = rows.select(F.try_parse_json(column).alias("v"))
    text = lambda at: F.expr(f"CASE WHEN schema_of_variant(value) = 'STRING' THEN variant_get(value, '{at}', 'string') END")
    items = lambda at: whole.select(F.expr(f"CASE WHEN startswith(schema_of_variant(try_variant_get(v, '$.{at}', 'variant')), 'ARRAY') THEN CAST(variant_get(v, '$.{at}', 'variant') AS ARRAY<VARIANT>) END").alias("a")).select(F.explode("a").alias("value"))
    field = lambda name: F.expr(f"CASE WHEN schema_of_variant(try_variant_get(value, '$.{name}', 'variant')) = 'STRING' THEN variant_get(value, '$.{name}', 'string') END").alias(name)
    keep = items("keep").select(text("$").alias("path")).filter("path is not null")
    return keep, items("renames").select(field("path"), field("new_name"), field("target_dir")).filter("path is not null")
