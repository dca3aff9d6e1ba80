"""A training-data pipeline over ``documents``: five stages, each one operator of quarrystone.llm.

Each stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import classify, jaccard, packing, pii, substrings
from quarrystone.llm.common import tables_dropped, written
from quarrystone.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = classify.fit_quality(docs, table(spark, sf_dir, "labels"))
    return classify.quality_scores(docs, model, score="__score").where(F.col("__score") >= classify.ACCEPT).drop("__score")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8."""
    return jaccard.one_of_each(docs, width=5, num=80, den=100)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut."""
    return substrings.without_repeats(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: token ids, with a checksum."""
    return packing.checksums(packing.pack(docs, tokenizer_path()), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the packing; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that a stage needed are deleted when its result is stored."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_dropped(spark, but=last):
            docs = written(stage(spark, docs, sf_dir), name, last)
    return docs
