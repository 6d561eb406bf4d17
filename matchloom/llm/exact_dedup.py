"""Exact dedup by skew-safe combining: local, salted, then global winners of equal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import SPACES, join_skewed, small, staged, table

#: Salts that a hot text's partial winners are spread over before the last merge.
SALTS = 16

#: Order keys are n_chars * 10^20 + (2^63 - 1 - doc_id), so that one decimal maximum finds the winner.
_SPAN = "100000000000000000000"
_TOP = 2**63 - 1


def _id_in(best: Column) -> Column:
    """The id that an order key holds; null for a row without one."""
    top = F.lit(_TOP).cast("decimal(38,0)")
    return F.nullif((top - F.pmod(best, F.lit(_SPAN).cast("decimal(38,0)"))).cast("long"), F.lit(_TOP))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row of docs with the row that stays for its text.

    Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; the row with the
    most code points in the original text stays, then the smallest id. Null texts count as empty, empty
    texts are equal to each other. A null id sorts after all others; where a row without one stays, keep_id is null
    and exactly one such row is kept. A repeated row (same id and text) counts in group_size and is kept with its
    twin. Other columns of docs are ignored, so clashing names
    do no harm. An empty table gives an empty result.

    Returns id_col, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text).

    Plan: hash aggregation on (digest, normalised text) inside each task, merge of the local winners over
    salted keys, merge of the salt winners, the full text being a grouping key at all three. Only then are
    rows joined to winners, by digest, with hot groups by a bounded broadcast. Should two texts share a
    digest, their rows are told apart by the text itself.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, "").alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("norm"), 256)))
    order = F.col("n").cast("decimal(38,0)") * F.lit(_SPAN).cast("decimal(21,0)") + (
        F.lit(_TOP).cast("decimal(20,0)") - F.coalesce(F.col("doc_id"), F.lit(_TOP)).cast("decimal(20,0)")
    )
    local = (
        rows.withColumn("best", order.cast("decimal(38,0)"))
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.max("best").alias("best"), F.count("*").alias("size"))
    )
    whole = local.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("size").alias("group_size"))
    # Texts that share a digest: none in practice, and exact if there are any.
    winners = staged(
        whole.groupBy("digest").agg(
            F.max("best").alias("best"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        ),
        "winners",
    ).withColumn("keep_id", _id_in(F.col("best")))
    unnamed = F.when(F.col("doc_id").isNull(), F.struct("n", F.monotonically_increasing_id().alias("row")))
    ids = staged(rows.select("doc_id", "digest", unnamed.alias("unnamed")), "ids")
    total = ids.count()
    plain = winners.filter("texts = 1").select("digest", "keep_id", "group_size")
    clash = winners.filter("texts > 1").select("digest")
    out = join_skewed(ids, plain, ["digest"], "group_size", total)
    if clash.limit(1).count():
        numbered = rows.withColumn("unnamed", unnamed)
        apart = staged(numbered.join(clash, "digest", "left_semi").select("doc_id", "digest", "norm", "unnamed", order.alias("best")), "apart")
        best = apart.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
        best = best.withColumn("keep_id", _id_in(F.col("best")))
        out = out.filter(F.col("group_size").isNotNull()).unionByName(
            apart.drop("best").join(best.drop("best"), ["digest", "norm"]).select(*out.columns)
        )
    kept = F.col("doc_id") == F.col("keep_id")
    lone = ids.filter(F.col("unnamed").isNotNull())
    if lone.limit(1).count():
        first = staged(lone.groupBy("digest").agg(F.max("unnamed").alias("first"), F.count("*").alias("w")), "first")
        named = out.filter(F.col("unnamed").isNull()).withColumn("first", F.lit(None).cast(first.schema["first"].dataType))
        out = named.unionByName(join_skewed(out.filter(F.col("unnamed").isNotNull()), first, ["digest"], "w", total).select(*named.columns))
        kept = kept | (F.col("keep_id").isNull() & (F.col("unnamed") == F.col("first")))
    return out.select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(kept, F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they came.

    The row that stays is that of exact_groups(). Ids are taken to be unique but for repeated rows: of rows
    with the id that stays, the one with the longest text stays (of equal ones any, they are the same). Rows without
    an id stay where the longest text of their group has none, one of them by group.
    The ids that go are broadcast if few (counted), else shuffled against docs.
    """
    groups = staged(exact_groups(docs, id_col, text_col), "groups")
    named = docs.filter(F.col(id_col).isNotNull())
    stay = groups.filter(F.col("kept") & F.col(id_col).isNotNull())
    go = groups.filter(~F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct().join(stay.select(id_col), id_col, "left_anti")
    out = named.join(small(go), id_col, "left_anti").select(*docs.columns)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    length = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    twice = stay.groupBy(id_col).count().filter("count > 1").select(id_col)
    if twice.limit(1).count():
        one = out.join(small(twice), id_col, "left_semi").groupBy(id_col).agg(F.max_by(whole, length).alias("r")).select("r.*")
        out = out.join(small(twice), id_col, "left_anti").select(*docs.columns).unionByName(one)
    lone = groups.filter(F.col("kept") & F.col(id_col).isNull()).select(F.col("text_sha256").alias("_sha"))
    if lone.limit(1).count():
        norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, "")
        rows = docs.filter(F.col(id_col).isNull()).select(whole.alias("_r"), norm.alias("_norm"), length.alias("_n"), F.sha2(norm, 256).alias("_sha"))
        one = rows.join(small(lone), "_sha", "left_semi").groupBy("_sha", "_norm").agg(F.max_by("_r", "_n").alias("r")).select("r.*")
        out = out.unionByName(one)
    return out


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
