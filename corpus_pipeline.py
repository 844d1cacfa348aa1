"""The corpus pipeline: documents are filtered for quality and toxicity, near-duplicates go, and the rest is packed.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; all but the last return the
columns of docs. Null texts count as empty, very long ones are read whole, repeated rows are judged one by one until the
near-duplicate stage, which keeps one of them, and an empty table gives an empty result. Further columns of docs are passed
on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import near, quality, toxic
from parley.llm.queries import KEEP_QUALITY, pack
from parley.llm.shared import documents, named, stored, unused


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the better grade reaches KEEP_QUALITY."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = unused(docs, "quality_expected", "quality_tail")
    return quality.graded(docs, model, names=tuple(names)).where(F.col(names[1]) >= KEEP_QUALITY).select(named(docs))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under the threshold."""
    model = toxic.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = unused(docs, "toxic_score", "toxic_spans")
    return toxic.toxicity(docs, model, tuple(docs.columns), tuple(names)).where(F.col(names[0]) < toxic.THRESHOLD).select(named(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that hangs together by five-word Jaccard likeness of 0.8 or more."""
    return near.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", good), ("toxicity", civil), ("near-duplicates", distinct), ("packing", packed)]

#: Trained models and tokenizers can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each returns is written down for the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
