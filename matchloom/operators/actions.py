"""Plans of moves and renames, as rows; only the driver carries them out."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions.paths import base_name, parent, stem, suffix, trash_path


def to_delete(members: DataFrame, keep: DataFrame) -> DataFrame:
    """Members that aren't kept. keep: path."""
    return members.join(keep.select("path").distinct(), "path", "left_anti")


def unguarded(members: DataFrame, keep: DataFrame) -> DataFrame:
    """group_id of groups of which nothing is kept: a decision that must be refused."""
    kept = members.join(keep.select("path").distinct().withColumn("_k", F.lit(True)), "path", "left")
    return kept.groupBy("group_id").agg(F.bool_or(F.coalesce("_k", F.lit(False))).alias("kept")).filter("not kept").select("group_id")


def recoverable(members: DataFrame, keep: DataFrame) -> DataFrame:
    return to_delete(members, keep).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def _family(path: Column) -> Column:
    """A path without the numbers that free names add: names that could ever clash share it."""
    return F.concat_ws("/", parent(path), F.regexp_replace(base_name(path), r"(?:_\d+)+(?=\.[^.]*$|$)", ""))


def _candidate(dst: Column, n: Column) -> Column:
    name = base_name(dst)
    return F.when(n == 0, dst).otherwise(F.concat_ws("/", parent(dst), F.concat(stem(name), F.lit("_"), n.cast("string"), suffix(dst))))


def unique_targets(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """moves (src, dst) with free, different targets: in the order of src each takes the first of dst, stem_1, stem_2, ... that
    neither `taken` (path) nor an earlier move has.

    Names that may clash form families by folder and name without numbers. Where all moves of a family want one
    target, the k-th move gets the k-th free number, counted beside the taken ones in one sort; families of several
    targets, where the numbers of one may be names of another, are decided move by move, by one task each.
    """
    made = moves.select("src", "dst", _family(F.col("dst")).alias("_key"))
    kinds = made.groupBy("_key").agg((F.min("dst") == F.max("dst")).alias("_plain"), F.min("dst").alias("_one"))
    used = taken.select(F.col("path").alias("_p"), _family(F.col("path")).alias("_key")).distinct().join(kinds, "_key")
    made = made.join(kinds.select("_key", "_plain"), "_key")

    number = F.regexp_extract(F.col("_p"), r"_([1-9]\d{0,17})(?:\.[^.]*)?$", 1).try_cast("long")
    at = F.when(F.col("_p") == F.col("_one"), F.lit(0).cast("long")).when(_candidate(F.col("_one"), number) == F.col("_p"), number)
    full = used.filter("_plain").select("_key", at.alias("_t")).filter("_t is not null")
    # the j-th taken number t (from 0) shifts all moves from the (t - j)-th on by one
    shifts = full.withColumn("_k", F.col("_t") - (F.row_number().over(W.partitionBy("_key").orderBy("_t")) - 1)).select("_key", "_k", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(1).alias("_up"))
    plain = made.filter("_plain").withColumn("_k", (F.row_number().over(W.partitionBy("_key").orderBy("src")) - 1).cast("long"))
    plain = plain.select("_key", "_k", F.col("src").cast("string").alias("src"), "dst", F.lit(0).alias("_up"))
    both = shifts.unionByName(plain).withColumn("_n", F.col("_k") + F.sum("_up").over(W.partitionBy("_key").orderBy("_k", F.desc("_up")).rowsBetween(W.unboundedPreceding, 0)))
    easy = both.filter("_up = 0").select("src", _candidate(F.col("dst"), F.col("_n")).alias("dst"))

    turn = F.row_number().over(W.partitionBy("_key").orderBy("src")).alias("turn")
    mixed = made.filter("not _plain").select("_key", turn, F.col("src").cast("string").alias("src"), "dst", F.lit(None).cast("string").alias("path"))
    names = used.filter("not _plain").select("_key", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("_p").alias("path"))
    hard = mixed.unionByName(names).groupBy("_key").applyInPandas(_one_by_one, "src string, dst string")
    out = easy.unionByName(hard)
    return out.withColumn("src", F.col("src").cast(moves.schema["src"].dataType))


def _one_by_one(pdf):
    import pandas as pd

    taken = set(pdf["path"].dropna())
    todo = pdf[pdf["dst"].notna()].sort_values("turn")
    got, after = [], {}
    for dst in todo["dst"]:
        folder, name = os.path.split(dst)
        dot = name.rfind(".")
        root, ext = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        n, free = after.get(dst, 0), dst  # numbers below were taken before
        while (free := dst if n == 0 else os.path.join(folder, f"{root}_{n}{ext}")) in taken:
            n += 1
        after[dst] = n + 1
        taken.add(free)
        got.append(free)
    return pd.DataFrame({"src": list(todo["src"]), "dst": got}, dtype=object)


def trash_plan(rows: DataFrame, root: Column) -> DataFrame:
    """src, dst in the trash folder, status 'ok' or 'outside'."""
    dst = trash_path(F.col("path"), root)
    return rows.select(F.col("path").alias("src"), dst.alias("dst"), F.when(dst.isNull(), "outside").otherwise("ok").alias("status"))


def transform_plan(requests: DataFrame, keep: DataFrame, inventory: DataFrame, folders: DataFrame, root: Column) -> DataFrame:
    """requests (path, new_name, target_dir) with dst and status: ok, noop, or why not.

    A source must be kept, below root and in the inventory (path); a new name counts as its last part; a target
    folder must be below root and one of `folders` (dir); a target that exists is refused.
    """
    below = lambda p: (p == root) | F.startswith(p, F.concat(root, F.lit("/")))
    flag = lambda df, c, n: df.select(F.col(c)).distinct().withColumn(n, F.lit(True))
    name = F.when(F.col("new_name").isNotNull(), F.element_at(F.split(F.rtrim(F.col("new_name"), F.lit("/")), "/"), -1)).otherwise(base_name(F.col("path")))
    folder = F.coalesce("target_dir", parent(F.col("path")))
    out = (
        requests.withColumn("dst", F.concat_ws("/", folder, name))
        .join(flag(keep, "path", "_kept"), "path", "left")
        .join(flag(inventory, "path", "_there"), "path", "left")
        .join(flag(inventory, "path", "_exists").withColumnRenamed("path", "dst"), "dst", "left")
        .join(flag(folders, "dir", "_dir").withColumnRenamed("dir", "target_dir"), "target_dir", "left")
    )
    status = (
        F.when(F.col("_kept").isNull(), "not kept")
        .when(~below(F.col("path")), "outside")
        .when(F.col("_there").isNull(), "missing")
        .when(name == "", "no name")
        .when(F.col("target_dir").isNotNull() & ~below(F.col("target_dir")), "target outside")
        .when(F.col("target_dir").isNotNull() & F.col("_dir").isNull(), "target missing")
        .when(F.col("dst") == F.col("path"), "noop")
        .when(F.col("_exists").isNotNull(), "exists")
        .otherwise("ok")
    )
    return out.select(F.col("path").alias("src"), "dst", status.alias("status"))


def confirm_plan(members: DataFrame, keep: DataFrame, requests: DataFrame, inventory: DataFrame, folders: DataFrame, root: Column) -> DataFrame:
    """A whole decision as rows: phase, src, dst, status.

    members (group_id, path), keep (path), requests (path, new_name, target_dir), inventory (path) and folders (dir)
    of what is there. Phase 0 holds a row 'refused' for each group that would lose all its files, phase 1 the moves
    to the trash with free names, phase 2 renames and moves of kept files, which may take names that phase 1 vacates.
    carry_out() does nothing of a plan with refused rows.
    """
    refused = unguarded(members, keep).select(F.lit(0).alias("phase"), F.col("group_id").cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit("refused").alias("status"))
    gone = to_delete(members.select("path").distinct(), keep)
    plan = trash_plan(gone, root)
    inside = plan.filter("status = 'ok'").select("src", "dst")
    trash = unique_targets(inside, inventory).select(F.lit(1).alias("phase"), "src", "dst", F.lit("ok").alias("status"))
    outside = plan.filter("status != 'ok'").select(F.lit(1).alias("phase"), "src", "dst", "status")
    left = inventory.select("path").join(gone, "path", "left_anti")
    change = transform_plan(requests, keep, left, folders, root).select(F.lit(2).alias("phase"), "src", "dst", "status")
    return refused.unionByName(trash).unionByName(outside).unionByName(change)


def _inside(path: str, root: str) -> bool:
    """Is a file, or the place for one, below root once links are followed?"""
    return os.path.realpath(os.path.dirname(path)).startswith(os.path.join(os.path.realpath(root), "")) or os.path.realpath(os.path.dirname(path)) == os.path.realpath(root)


def carry_out(plan: DataFrame, dry_run: bool = True, root: str | None = None) -> dict[str, int]:
    """Moves the rows with status ok, on the driver, phase by phase, one after the other as they stream in; counts by outcome.

    Nothing is done if any row is refused. root: what lies outside of it, once links are followed, is an error and
    stays. A dry run keeps account of the names it would vacate and take.
    """
    done = {"moved": 0, "skipped": 0, "errors": 0, "refused": plan.filter("status = 'refused'").count()}
    if done["refused"]:
        return done
    phased = plan if "phase" in plan.columns else plan.withColumn("phase", F.lit(1))
    vacated, filled = set(), set()
    for row in phased.filter("status = 'ok'").orderBy("phase", "src").toLocalIterator():
        there = (os.path.isfile(row.src) and row.src not in vacated) or row.src in filled
        if not there:
            done["skipped"] += 1
        elif root is not None and not (_inside(row.src, root) and _inside(row.dst, root)):
            done["errors"] += 1
        elif (os.path.lexists(row.dst) and row.dst not in vacated) or row.dst in filled:
            done["errors"] += 1
        elif dry_run:
            vacated.add(row.src)
            filled.discard(row.src)
            vacated.discard(row.dst)
            filled.add(row.dst)
            done["moved"] += 1
        else:
            try:
                os.makedirs(os.path.dirname(row.dst), exist_ok=True)
                shutil.move(row.src, row.dst)
                done["moved"] += 1
            except OSError:
                done["errors"] += 1
    return done
