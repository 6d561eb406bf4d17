"""Which member of a group stays, and under which name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.paths import base_name, parent
from matchloom.functions.scoring import folder_score, name_score


def scored(members: DataFrame, extra: Sequence[str] = (), base: Column | None = None) -> DataFrame:
    """members (group_id, ordinal, path, ...) with name, dir, name_score, folder_score."""
    out = members.withColumn("name", base_name(F.col("path"))).withColumn("dir", parent(F.col("path")))
    return out.withColumn("name_score", name_score(F.col("name"), extra)).withColumn("folder_score", folder_score(F.col("dir"), extra, base))


def smart_defaults(scored_members: DataFrame) -> DataFrame:
    """group_id, keep (the first member), rename_src and folder_src: the first of the best score above the first member's, or null."""
    best = lambda c: F.max_by("path", F.struct(F.col(c), -F.col("ordinal")))
    at = lambda c: F.max(F.struct(F.col(c), -F.col("ordinal")))["col2"]
    out = scored_members.groupBy("group_id").agg(
        F.min_by("path", "ordinal").alias("keep"), best("name_score").alias("_n"), at("name_score").alias("_ni"), best("folder_score").alias("_f"), at("folder_score").alias("_fi")
    )
    return out.select("group_id", "keep", F.when(F.col("_ni") < 0, F.col("_n")).alias("rename_src"), F.when(F.col("_fi") < 0, F.col("_f")).alias("folder_src"))


def pick_keeper(scored_members: DataFrame) -> DataFrame:
    """group_id, keep: the greatest (folder_score, name_score), the first of equals."""
    return scored_members.groupBy("group_id").agg(F.max_by("path", F.struct("folder_score", "name_score", -F.col("ordinal"))).alias("keep"))


def exact_keep(scored_members: DataFrame) -> DataFrame:
    """group_id, keep, final: the keeper, and its path with the group's best name if that beats the keeper's own."""
    out = scored_members.groupBy("group_id").agg(
        F.max_by(F.struct("path", "dir", "name_score"), F.struct("folder_score", "name_score", -F.col("ordinal"))).alias("k"),
        F.max_by(F.struct("name", "name_score"), F.struct("name_score", -F.col("ordinal"))).alias("b"),
    )
    final = F.when(F.col("b.name_score") > F.col("k.name_score"), F.concat_ws("/", "k.dir", "b.name")).otherwise(F.col("k.path"))
    return out.select("group_id", F.col("k.path").alias("keep"), final.alias("final"))
