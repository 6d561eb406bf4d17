"""Quality rules whose thresholds come from mergeable quantile sketches, in DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.common import SPACES, small, staged, table

SYMBOLS = "#*$%&|<>"
#: Below so many words, or above so many per cent of repeated words, a text fails whatever its group is like.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A text is an outlier beyond q75 + FENCE * (q75 - q50) + the feature's margin, or below q25 - FENCE * (q50 - q25) - margin.
FENCE = 8
#: A group's limits stay within so many times those of its parent: what fills a group can't switch a rule off there.
REACH = 3
#: Groups of fewer texts take the thresholds of their language, and those of all texts below that.
MIN_ROWS = 50
#: Feature and least margin in thousandths, so that a group without spread doesn't reject what is close to it.
MARGINS = {"symbols": 60, "dup_lines": 150, "repeats": 150, "word_length": 20}
#: Features with a least value too.
TWO_SIDED = ("word_length",)
#: Mean word length a counts as a / (a + WORD) thousandths: below 1000 for words of any length.
WORD = 30


def _has_word(line: Column) -> Column:
    return F.char_length(F.translate(line, SPACES, "")) > 0


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are looked for in two steps: hashes of the 3-word windows, all different in most texts
    (then so are the windows), and only where some are equal the windows themselves, sorted with their
    places. Nothing is exploded, so no row leaves its task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c != text_col]
    # Words hold no blanks, so three joined by blanks are one window only.
    one = docs.select(
        *kept,
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("_words"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), _has_word).alias("_lines"),
    )
    n = F.size("_words")
    two = one.select(
        *kept,
        "_words",
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.slice(F.col("_words"), F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    windows = F.array_sort(
        F.transform(
            F.slice(F.col("_words"), F.lit(1), n - 2),
            lambda w, i: F.struct(F.concat_ws(" ", w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("w"), i.alias("i")),
        )
    )
    three = two.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), windows)).drop("_hashes", "_words")
    twice = F.filter(
        "_sorted",
        lambda x, i: (F.get("_sorted", i - 1)["w"].eqNullSafe(x["w"])) | (F.get("_sorted", i + 1)["w"].eqNullSafe(x["w"])),
    )
    four = three.withColumn("_at", F.transform(twice, lambda x: x["i"])).drop("_sorted")
    covered = F.array_union(F.array_union("_at", F.transform("_at", lambda p: p + 1)), F.transform("_at", lambda p: p + 2))
    return four.select(
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"),
    )


def _feature(name: str) -> Column:
    """Whole thousandths, 0 to 1000, by whole-number division, so that any engine gets the same."""
    per = {
        "symbols": ("n_symbols", F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": ("n_dup_lines", F.col("n_dup_lines") + 10),
        "repeats": ("n_repeat_words", F.greatest(F.col("n_words"), F.lit(1))),
        "word_length": ("word_chars", F.col("word_chars") + F.greatest(F.col("n_words"), F.lit(1)) * WORD),
    }[name]
    return F.floor(F.col(per[0]) * 1000 / per[1]).cast("long")


def sketches(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches: for each group and feature the count of every value in thousandths.

    At most 1001 rows for a group and feature, whatever its size; two sketches merge by adding counts, which
    is exact and independent of order. Rows: keys, feature, value, n.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in MARGINS])
    # equal rows are combined before they are taken apart by feature
    return (
        counts.groupBy(*keys, *[_feature(f).alias(f) for f in MARGINS])
        .agg(F.count("*").alias("n"))
        .select(*keys, "n", F.explode(pairs).alias("x"))
        .groupBy(*keys, "x.feature", "x.value")
        .agg(F.sum("n").alias("n"))
    )


def _limits() -> list[str]:
    return [*(f"most_{f}" for f in MARGINS), *(f"least_{f}" for f in TWO_SIDED)]


def thresholds(sketch: DataFrame, keys: list[str], fence: int = FENCE) -> DataFrame:
    """Largest values allowed, by group and feature: q75 + fence * (q75 - q50) + margin; least ones likewise, 0 or more.

    Rows: keys, rows, most_ and least_ columns by feature.
    """
    by = W.partitionBy(*keys, "feature")
    ranked = sketch.withColumn("_to", F.sum("n").over(by.orderBy("value"))).withColumn("_all", F.sum("n").over(by))
    at = lambda quarters: F.min(F.when(F.col("_to") * 4 >= F.col("_all") * quarters, F.col("value")))
    q = ranked.groupBy(*keys, "feature").agg(F.first("_all").alias("rows"), at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75"))
    margin = reduce(lambda c, f: c.when(F.col("feature") == f, F.lit(MARGINS[f])), MARGINS, F.when(F.lit(False), F.lit(0)))
    most = F.col("q75") + F.lit(fence) * (F.col("q75") - F.col("q50")) + margin
    least = F.greatest(F.col("q25") - F.lit(fence) * (F.col("q50") - F.col("q25")) - margin, F.lit(0))
    return q.withColumn("most", most).withColumn("least", least).groupBy(*keys).agg(
        F.first("rows").alias("rows"),
        *[F.max(F.when(F.col("feature") == f, F.col("most"))).alias(f"most_{f}") for f in MARGINS],
        *[F.max(F.when(F.col("feature") == f, F.col("least"))).alias(f"least_{f}") for f in TWO_SIDED],
    )


def _within_reach(limit: str, own: Column, parent: Column) -> Column:
    return F.least(own, parent * REACH) if limit.startswith("most") else F.greatest(own, F.floor(parent / REACH).cast("long"))


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: int = FENCE, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Counts and verdict for every row of docs.

    A text fails at once with under MIN_WORDS words or over MAX_REPEAT_PCT per cent of its words in repeated
    3-word windows. The rest is held against the thresholds of its language and source: a text is kept if
    none of its features (symbols by character, repeated lines, repeated words, mean word length) is beyond
    the fence that the group's own quantiles set, within reach of those of its language and of all texts. The texts that fail at once are left out of the sketches.
    Groups under min_rows texts use the merged sketch of their language, or of all.

    Null texts have no words. Null languages and sources are groups of their own. Ties and repeated rows need
    no order: thresholds come from counts. Empty tables give empty results; other columns are ignored.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.
    """
    counts = staged(
        rule_counts(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.col(lang_col).cast("string").alias("lang"),
                F.col(source_col).cast("string").alias("source"),
                F.col(text_col).alias("text"),
            )
        ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)),
        "counts",
    )
    fine = staged(sketches(counts.filter("not base_failed"), ["lang", "source"]), "sketch")
    by_lang = fine.groupBy("lang", "feature", "value").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("feature", "value").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    names = _limits()
    lim = thresholds(fine, ["lang", "source"], fence).alias("g")
    lim_lang = thresholds(by_lang, ["lang"], fence).select(F.col("lang").alias("_l"), F.col("rows").alias("_n"), *[F.col(c).alias(f"l_{c}") for c in names])
    lim_all = thresholds(by_all, ["one"], fence).select(*[F.col(c).alias(f"a_{c}") for c in names])
    groups = lim.join(lim_lang, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(lim_all))  # lim_all: one row
    for c in names:
        of_lang = F.when(F.col("_n") >= min_rows, _within_reach(c, F.col(f"l_{c}"), F.col(f"a_{c}"))).otherwise(F.col(f"a_{c}"))
        groups = groups.withColumn(f"l_{c}", of_lang)
    chosen = staged(
        groups.select(
            F.col("lang").alias("_lang"),
            F.col("source").alias("_source"),
            *[F.when(F.col("rows") >= min_rows, _within_reach(c, F.col(c), F.col(f"l_{c}"))).otherwise(F.col(f"l_{c}")).alias(c) for c in names],
        ),
        "thresholds",
    )
    held = counts.join(
        small(chosen), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    within = reduce(lambda a, b: a & b, [*[_feature(f) <= F.col(f"most_{f}") for f in MARGINS], *[_feature(f) >= F.col(f"least_{f}") for f in TWO_SIDED]])
    return held.select(
        F.col("doc_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(True))).alias("kept"),
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


_FEATURES = f"""
  n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
  n_dup_lines * 1000 // (n_dup_lines + 10) AS dup_lines,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
  word_chars * 1000 // (word_chars + greatest(n_words, 1) * {WORD}) AS word_length
"""
_Q = "quantile_disc({f}, {q})"
_LIMITS = ", ".join(
    [f"{_Q.format(f=f, q=0.75)} + {FENCE} * ({_Q.format(f=f, q=0.75)} - {_Q.format(f=f, q=0.5)}) + {m} AS most_{f}" for f, m in MARGINS.items()]
    + [f"greatest({_Q.format(f=f, q=0.25)} - {FENCE} * ({_Q.format(f=f, q=0.5)} - {_Q.format(f=f, q=0.25)}) - {MARGINS[f]}, 0) AS least_{f}" for f in TWO_SIDED]
)


def _reach_sql(c: str, own: str, parent: str) -> str:
    return f"least({own}, {parent} * {REACH})" if c.startswith("most") else f"greatest({own}, {parent} // {REACH})"


_LANG = ", ".join(f"CASE WHEN l.n >= {MIN_ROWS} THEN {_reach_sql(c, f'l.{c}', f'a.{c}')} ELSE a.{c} END AS {c}" for c in _limits())
_CHOSEN = ", ".join(f"CASE WHEN g.n >= {MIN_ROWS} THEN {_reach_sql(c, f'g.{c}', f'l.{c}')} ELSE l.{c} END AS {c}" for c in _limits())
SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), w AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM w) WHERE c > 1
  ) GROUP BY doc_id
), c AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PCT} AS base_failed, {_FEATURES} FROM c
), g AS (SELECT lang, source, count(*) AS n, {_LIMITS} FROM f WHERE NOT base_failed GROUP BY ALL),
l2 AS (SELECT lang, count(*) AS n, {_LIMITS} FROM f WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT {_LIMITS} FROM f WHERE NOT base_failed),
l3 AS (SELECT l.lang, {_LANG} FROM l2 AS l CROSS JOIN a),
t AS (SELECT g.lang, g.source, {_CHOSEN} FROM g JOIN l3 AS l ON g.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join([*(f"{f} <= most_{f}" for f in MARGINS), *(f"{f} >= least_{f}" for f in TWO_SIDED)])}, true) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
