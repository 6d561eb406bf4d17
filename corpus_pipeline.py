"""Corpus pipeline: good documents, one of each text, one of each near-duplicate class, mixed by source, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import exact_dedup, mixing, ngram_join, packing, quality_zstd
from matchloom.llm.common import drop_staged, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the compression classifier rejects, learning from labels outside the held-out fold.

    Null texts are empty; empty ones, having no difference, stay or go by the score of difference 0. Where labels are
    of one class or absent, nothing goes. Repeated rows fare alike; an empty table gives an empty result.
    """
    model = quality_zstd.fit_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_zstd.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text: the longest as written, then that of least id.

    Null and empty texts are one text. Of repeated rows one stays; rows without an id stay where no longer or equal
    text of theirs has one, one of each text. An empty table gives an empty result.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of texts at n-gram similarity of 0.8 or more, on five words.

    Texts without words, null ones too, are in no class and stay. Rows without an id go if their class has one with
    an id; else one of the class stays. An empty table gives an empty result.
    """
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their targets.

    Null sources are one source, the last; null and empty texts have size 0 and get the certain copies only. Repeated
    rows are documents of their own. An empty table gives an empty result.
    """
    return mixing.repeat_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places.

    Null texts are empty: one piece, the end id. Repeated rows are pieces of their own, with equal ids. An empty
    table gives an empty result.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("packing", packed)]

#: Classifier, MinHash candidates and packing aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's input is deleted after it.

    Odd rows fare as each stage says; an empty table of documents gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
