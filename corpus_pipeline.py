"""From raw documents to a training mix, in five stages.

Each stage takes all that the one before kept, is written and read again, and
keeps whatever it has no reason to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm import decontaminate, line_dedup, mixing, quality, simhash
from assetloom.llm.common import table
from assetloom.session import cut_lineage

LEAST_SCORE = 0.3


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3, by a model fitted to the labels of this folder."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.filter_quality(docs, model, LEAST_SCORE)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that three or more share."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles, linked at two differing bits or fewer."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_shared_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


# A fitted discriminant and fingerprints of hashed shingles have no SQL form.
ORACLE_SQL = None
