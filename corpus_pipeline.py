"""The corpus pipeline: five stages over documents, each written and read again.

1. toxicity: fit on the labelled rows of labels, documents predicted toxic go;
2. near_dedup: one row of each group of near duplicates (0.8 of their 5-word shingles shared) stays;
3. substring_dedup: words of passages of 35 words or more that occur more than once among what is left go;
4. decontamination: documents that hold 80 % of a benchmark item's shingles go;
5. bpe: what is left is encoded and decoded; the result is a digest a document.

Each stage judges its own input, row by row, whether a row has a doc_id, shares it with others, or lacks one. All but the last return the columns of documents. SQL can't express learned scores, so
there is no oracle; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, near_dedup, substring_dedup
from ledgerloom.llm import toxicity as tox
from ledgerloom.llm.common import Stage, lean, table

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.without_toxic(docs, *tox.fit(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return near_dedup.without_copies(spark, docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return substring_dedup.cleaned(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return decontaminate.without_items(spark, docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [("toxicity", toxicity), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("decontamination", decontamination), ("bpe", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, step in STAGES:
        before, docs = docs, stage.write(step(spark, docs, sf_dir), name)
        stage.drop(before)  # of written tables only
        stage.release()
    return docs
