"""Corpus preparation in five stages over ``documents``: rules, near copies, passages, leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All stages but the last return the columns of ``documents``, and those that
clash with names used inside, unchanged. Texts are read whole, whatever their length; empty tables stay empty.
Stages run jobs while they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import decontamination, near_copies, packing, quality_rules, substring_dedup
from gleanery.llm.scratch import drop, materialize, temporary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the base rules or the learned list reject go.

    Null and empty texts have no words and go; of rows that repeat, all or none stay.
    """
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 at a similarity: of each group of near copies (five-word similarity of 0.8 or more) one row stays, by (id, text hash).

    Rows without an id come last in their group; of equal rows one stays; null texts and texts without words are copies of each other.
    """
    return near_copies.keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: words under windows that occur more than once are cut; ``n_chars`` follows the text.

    Null texts stay null; a text that is all repeats becomes empty, as do rows that repeat; no row goes.
    """
    cut = substring_dedup.replace_texts(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go.

    Null and empty texts stay; of rows that repeat, all or none stay; null and empty items match nothing.
    """
    return decontamination.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of the documents' tokens, with their sequences.

    A null or empty text is its end id alone; rows that repeat are documents of their own; ties go by id and place.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", passages), ("decontamination", leaks), ("packing", pack)]

#: The stages learn rules, link fingerprints and pack sequences, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage writes inside goes after it."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary(spark):
            docs = materialize(stage(spark, before, sf_dir), name, keep=True)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
