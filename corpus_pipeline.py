"""From documents to token ids: quality rules, toxicity, near-duplicates, mixing, SentencePiece. One table between stages.

Every stage takes null ids, texts, languages and sources, and repeated rows, as rows of their own; an empty table gives an
empty one. All but the last return the columns of their documents with their values, also those named like columns that an
operator adds. A stage's result is to be written before the next stage is called: staged tables that it reads go then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramlake.llm import mixing, pieces, quality, superminhash, toxicity
from gramlake.llm.queries import tokenizer
from gramlake.llm.runtime import between_stages, release, stage


@between_stages
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; ties at a threshold stay."""
    return quality.passed(docs)


@between_stages
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold. Labels are learned from where the documents reach this stage; without any, every document stays."""
    return toxicity.passed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@between_stages
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity of 0.8 or more): that of the smallest id. Documents without words,
    and those without an id, stay."""
    return superminhash.deduplicated(docs, 5, 80)


@between_stages
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.repeated(docs)


@between_stages
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded text."""
    return pieces.encoded(docs, tokenizer(), with_ids=True)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic), ("near duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: The stages score and sketch: SQL cannot express them. tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on documents, each written to the shared folder and read again; a table goes when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
