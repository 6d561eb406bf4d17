"""Bounded samples of labelled rows, for the classifiers that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import fold

#: Labelled texts beyond so many bytes aren't trained on (they are scored like all others).
LONGEST = 1 << 18


def sample(docs: DataFrame, labels: DataFrame, label: Column, keep: Column, rows: int, seed: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> list[tuple[str, int, int]]:
    """(text, label, crc32 of the id) of at most `rows` labelled documents: those of least hash of seed and id.

    labels: id_col and what `label` and `keep` read; rows with a null label or id are left out. The ids are chosen
    from labels alone, before any text is read, so at most rows * longest bytes reach the driver. Of several labels
    of an id the greatest counts, of several texts the greatest: every run trains on the same.
    """
    chosen = (
        labels.filter(keep & label.isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label.cast("int")).alias("_label"))
        .orderBy(F.xxhash64(F.lit(seed), id_col), id_col)
        .limit(rows)
    )
    return _texts(docs, chosen, id_col, text_col, longest)


def sample_unlabelled(docs: DataFrame, keep: Column, rows: int, seed: int, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> list[str]:
    """Texts of at most `rows` documents, whatever their labels: those of least hash of seed and id, found by the id column alone."""
    chosen = docs.filter(keep & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(rows)
    return [t for t, _, _ in _texts(docs, chosen.withColumn("_label", F.lit(0)), id_col, text_col, longest)]


def _texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, longest: int) -> list[tuple[str, int, int]]:
    """The chosen ids' texts. chosen: id_col, _label, so many rows as a caller's bound, so it is broadcast."""
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.octet_length("_text") <= longest)
    got = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "_label").agg(F.max("_text").alias("_text")).select(id_col, "_text", "_label", fold(2**32, id_col).alias("_crc"))
    return [(r._text, r._label, r._crc) for r in sorted(got.collect(), key=lambda r: (r._crc, r[id_col]))]
