"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import BROADCAST_ROWS, SPACES, small, staged, table

#: Weights that the sources get in code-point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target, and any document's share, stop at so many times its size.
MOST = 3
#: Order keys are counted in so many bins a source; only the bin where the target is reached is ranked.
BINS = 1 << 12


def n_words(column: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none. Counts word starts, without an array of words."""
    text = F.concat(F.lit(" "), F.translate(F.coalesce(column, F.lit("")), SPACES, " " * len(SPACES)))
    flat = F.regexp_replace(F.regexp_replace(text, "[^ ]+", "x"), " ", "")
    return F.char_length(flat).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """One row for each source: source, source_size, target.

    sizes: source (null counts as one, the last), source_size. The targets are weight * level, stopped at
    most * source_size; the level is such that they sum to share * all sizes, or as far as the stops let them.
    A source stops earlier the smaller most * size / weight, so the level follows from running sums in that
    order. The table is as long as there are sources.
    """
    n = len(weights)
    one = F.lit(1)
    by_name = W.partitionBy(one).orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy(one)
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    by_stop = W.partitionBy(one).orderBy(F.col("_stop"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = (
        ranked.withColumn("_cap", F.col("source_size") * most)
        .withColumn("_stop", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_stop), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(by_stop), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_wleft"))
        # the first source, in stop order, that its level leaves below its stop sets the level of all after it
        .withColumn("_found", F.min(F.when(F.col("_level") < F.col("_stop"), F.struct("_stop", "_level"))).over(whole))
    )
    target = F.when(F.col("_found").isNull(), F.col("_cap").cast("double")).otherwise(
        F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_found._level"))
    )
    return t.select("source", "source_size", target.alias("target"))


def uniform(column: Column, seed: int) -> Column:
    """A number in (0, 1) from the id and the seed, the same in every run and engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(column.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    odds_col: str | None = None,
    seed: int = 17,
    bins: int = BINS,
) -> DataFrame:
    """Number of copies of every document in a mix whose sources come near their targets.

    A source with target t and size s gives each document floor(t / s) certain whole copies. The rest,
    f = t / s - floor(t / s), is an order sample: document i has the inclusion odds f / (1 - f) * o_i, with
    o_i = sqrt(size / mean size of the source), or odds_col where given, and a uniform number u_i. Documents
    are ranked by (u / (1 - u)) / odds and the first ones are taken until their words come nearest to the
    rest of the target: a fixed size in words, with unequal probabilities.

    Returns id_col, size, source, source_size, target, copies, taken (= size * copies). Null texts have size
    0; null sources are one source, the last; documents of size 0 get the certain copies only. Rows with
    equal rank keys are ordered by id, then size; a repeated row is a document of its own. Empty tables give
    empty results. Other columns are ignored.

    No source is sorted as a whole: keys fall into bins of equal probability, words are summed by bin (with
    partial sums in each task), and only the one bin where a source reaches its target is ranked.
    """
    base, plan, edges = _prepare(docs, id_col, text_col, source_col, weights, share, most, odds_col, seed, bins)
    known = _placed(base, plan, edges, seed, bins)
    inside = _edge_rows(known)
    other = known.filter(~_at_edge()).withColumn("_more", _below_edge().cast("long"))
    copies = F.col("_whole") + F.col("_more")
    return inside.unionByName(other).select(
        F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def _at_edge() -> Column:
    return F.col("_bin").isNotNull() & F.col("_edge").isNotNull() & (F.col("_bin") == F.col("_edge"))


def _below_edge() -> Column:
    return F.col("_bin").isNotNull() & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))


def _prepare(docs, id_col, text_col, source_col, weights, share, most, odds_col, seed, bins) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of all documents; for each source its target and rates, and the bin in which it reaches its target."""
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
        *([F.col(odds_col).cast("double").alias("_o")] if odds_col else []),
    )
    base = staged(sized, "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = source_targets(sums.select("source", "source_size"), weights, share, most)
    plan = targets.join(sums.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = staged(
        plan.withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("_whole", F.floor(F.col("_rate")).cast("long"))
        .withColumn("_part", F.col("_rate") - F.col("_whole"))
        .withColumn("_rest", F.col("target") - (F.col("_whole") * F.col("source_size")).cast("double")),
        "targets",
    )
    binned = _keyed(base, plan, seed, bins).filter(F.col("_bin").isNotNull())
    by_bin = binned.groupBy("source", "_bin").agg(F.sum("size").alias("_w"), F.first("_rest").alias("_rest"))
    run = W.partitionBy("source").orderBy("_bin")
    # the bin in which the running sum of words passes the rest of the target
    reached = (
        by_bin.withColumn("_to", F.sum("_w").over(run))
        .filter(F.col("_to") >= F.col("_rest"))
        .groupBy("source")
        .agg(F.min(F.struct("_bin", (F.col("_to") - F.col("_w")).alias("_before"))).alias("m"))
        .select(F.col("source").alias("_s"), F.col("m._bin").alias("_edge"), F.col("m._before").alias("_before"))
    )
    return base, plan, staged(reached, "edges")


def _keyed(rows: DataFrame, plan: DataFrame, seed: int, bins: int) -> DataFrame:
    """rows (doc_id, source, size) with their source's figures, their rank key _k and its bin; no key where the source needs no sample."""
    odds = F.col("_o") if "_o" in rows.columns else F.sqrt(F.col("size") * F.col("_n") / F.col("source_size"))
    u = uniform(F.col("doc_id"), seed)
    key = (u / (1 - u)) / (F.col("_part") / (1 - F.col("_part")) * odds)
    return (
        rows.join(small(plan.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_k", F.when((F.col("size") > 0) & (F.col("_part") > 0), key))
        .withColumn("_bin", F.floor(F.col("_k") / (1 + F.col("_k")) * bins).cast("long"))
    )


def _placed(rows: DataFrame, plan: DataFrame, edges: DataFrame, seed: int, bins: int) -> DataFrame:
    return _keyed(rows, plan, seed, bins).join(small(edges), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def _edge_rows(placed: DataFrame) -> DataFrame:
    """The rows of the bins where sources reach their targets, each taken while that brings the sum nearer to the target."""
    order = W.partitionBy("source").orderBy("_k", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    to = F.col("_before") + F.sum("size").over(order)
    return (
        placed.filter(_at_edge())
        .withColumn("_to", to)
        .withColumn("_more", (F.col("_to") - F.col("_rest") <= F.col("_rest") - (F.col("_to") - F.col("size"))).cast("long"))
        .drop("_to")
    )


def repeat_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    seed: int = 17,
    bins: int = BINS,
) -> DataFrame:
    """docs with every row as often as mix() says, all columns as they came.

    Texts aren't shuffled: a row's copies follow from its own key and its source's figures. Only for the rows
    in the bins where sources reach their targets, about one in `bins`, is it looked up which are taken. Of rows with
    equal id, source and size as many get a copy more as in mix(). Null texts and sources as there; an empty table
    gives an empty result.
    """
    base, plan, edges = _prepare(docs, id_col, text_col, source_col, weights, share, most, None, seed, bins)
    keys = ["doc_id", "source", "size"]
    at_edge = _edge_rows(_placed(base, plan, edges, seed, bins)).groupBy(*keys).agg(F.sum("_more").alias("_t"), F.count("*").alias("_c"))
    taken = staged(at_edge.select(*[F.col(c).alias(f"_{c}") for c in keys], "_t", "_c"), "taken")
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & F.col("size").eqNullSafe(F.col("_size"))
    placed = _placed(rows, plan, edges, seed, bins).join(small(taken, 10 * BROADCAST_ROWS), same, "left")
    copies = lambda more: F.col("_whole").cast("int") + more.cast("int")
    spread = lambda df, more: df.select(F.explode(F.array_repeat("_row", copies(more))).alias("_row")).select("_row.*")
    every = F.when(_at_edge(), F.col("_t") == F.col("_c")).otherwise(_below_edge())
    some = taken.filter("_t > 0 and _t < _c")
    if not some.limit(1).count():
        return spread(placed, every)
    # rows that can't be told apart by id, source and size, of which some are taken: they are counted off
    part = _at_edge() & (F.col("_t") > 0) & (F.col("_t") < F.col("_c"))
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("_row")))
    counted = placed.filter(part).withColumn("_turn", turn)
    return spread(placed.filter(~F.coalesce(part, F.lit(False))), every).unionByName(spread(counted, F.col("_turn") <= F.col("_t")))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), a AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / w AS stop FROM s
), b AS (
  SELECT *, sum(source_size) OVER () * 1.0::DOUBLE AS tot,
         coalesce(sum(cap) OVER o, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS wleft
  FROM a WINDOW o AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, (tot - before)::DOUBLE / wleft AS level FROM b
), f AS (
  SELECT arg_min(level, stop) AS level FROM c WHERE level < stop
), t AS (
  SELECT source, source_size, n, CASE WHEN f.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * f.level) END AS target
  FROM c LEFT JOIN f ON true
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t
), q AS (
  SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, target - (floor(rate)::BIGINT * source_size)::DOUBLE AS rest FROM r
), u AS (
  SELECT d.doc_id, d.size, q.*, (('0x' || substr(md5('17:' || d.doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), k AS (
  SELECT *, CASE WHEN size > 0 AND part > 0 THEN (u / (1 - u)) / (part / (1 - part) * sqrt((size * n)::DOUBLE / source_size)) END AS k FROM u
), m AS (
  SELECT *, sum(CASE WHEN k IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY k NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM k
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN k IS NOT NULL AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""
