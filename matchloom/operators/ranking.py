"""Row numbers without a task that sees everything: ranges are sorted side by side and get the counts of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.operators.materialize import cut

#: Groups of more rows than this are sorted by ranges instead of by one task each.
HOT_GROUP = 1_000_000
#: monotonically_increasing_id(): the partition above, the row within it below this bit.
_BITS = 33


def numbered(rows: DataFrame, by: list[Column | str], within: list[str] | None = None) -> DataFrame:
    """rows with _n: their place from 0 in the order `by`, which must be total, or in that order among rows equal in `within`.

    One range shuffle; what is broadcast has a row for each partition, or for each partition and group in it, so
    `within` is for few groups.
    """
    keys = within or []
    order = [*map(F.col, keys), *by]
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _BITS)
    parts = placed.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = W.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), [*keys, "_part"])
    return out.withColumn("_n", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "_n")


def ranked(members: DataFrame, hot: int = HOT_GROUP) -> DataFrame:
    """group_id, path, size with ordinal (largest first, then path) and group_size; groups of one are left out.

    Sizes of groups come from partial counts. Groups of up to `hot` rows are sorted by one task each, larger ones,
    at most 1 / hot of all rows in number, by ranges of size and path.
    """
    order = [F.desc("size"), F.col("path")]
    rows = cut(members)
    sizes = cut(rows.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size >= 2"))
    large = sizes.filter(F.col("group_size") > hot)
    inside = W.partitionBy("group_id").orderBy(*order)
    columns = [*members.columns, "ordinal", "group_size"]
    if not large.limit(1).count():
        return rows.join(sizes, "group_id").withColumn("ordinal", F.row_number().over(inside) - 1).select(*columns)
    large = F.broadcast(large)
    rest = rows.join(large, "group_id", "left_anti").join(sizes, "group_id").withColumn("ordinal", F.row_number().over(inside) - 1)
    split = numbered(rows.join(large, "group_id"), order, ["group_id"]).withColumn("ordinal", F.col("_n").cast("int"))
    return rest.select(*columns).unionByName(split.select(*columns))


def group_heads(members: DataFrame, more: list[str] | None = None) -> DataFrame:
    """One row a group: group_id, n, max_size, first_path; by further columns too where named."""
    return members.groupBy("group_id", *(more or [])).agg(F.count("*").alias("n"), F.max("size").alias("max_size"), F.min_by("path", "ordinal").alias("first_path"))


#: Most files first, then the largest file, then the first path.
GROUP_ORDER = (F.desc, "n"), (F.desc, "max_size"), (F.asc, "first_path"), (F.asc, "group_id")


def group_order() -> list[Column]:
    return [f(c) for f, c in GROUP_ORDER]


def group_ranks(members: DataFrame) -> DataFrame:
    """group_heads() with rank from 1."""
    return numbered(group_heads(members), group_order()).withColumn("rank", F.col("_n") + 1).drop("_n")
