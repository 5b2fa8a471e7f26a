"""Cleans a corpus in five stages, each of one operator over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import decontaminate, exact_dedup, mixing, toxicity, wide_simhash
from chronolith.llm.common import table, written


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity chain rejects.

    Null and empty texts, null ids and texts without known words stay; very long texts are
    read whole; repeated rows of one text go or stay together. Nothing is dropped where
    there are no labels. An empty table stays empty; columns, whatever their names, stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the largest doc_id of equal texts, A-Z lower-cased.

    Null texts count as empty, and are copies of each other; a null id goes beside others.
    Repeated rows of one id stay or go together; texts of any length are compared whole. An
    empty table stays empty; columns, whatever their names, stay.
    """
    return exact_dedup.drop_copies(docs)


def similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates: wide SimHash, five-word shingles of a Jaccard index of 0.8 or more.

    Texts without words are alike; shorter ones than a shingle are compared by their words;
    very long ones by all their shingles. Groups are what links reach. Null ids and repeated
    rows fare as in wide_simhash. An empty table stays empty; columns, whatever their names, stay.
    """
    return wide_simhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage.

    Null and empty texts stay; very long ones are searched whole; repeated rows of one text
    go or stay together, null ids too. Null and empty items match nothing; without items all
    stay. An empty table stays empty; columns, whatever their names, stay.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


#: The domains that the stages before the last keep; their targets count as shares of their sum.
TARGETS = {name: mixing.TARGETS[name] for name in ("good", "low")}


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates and copies of every document that is left, for the target weights of the domains that are kept.

    Domains are learned from the labelled texts as they were before the other stages. A row
    for every row: null and empty texts have no tokens and a rate too, repeated rows count as
    often as they stand there. Without labels all rows have alike posteriors. An empty table
    gives no rows.
    """
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mix(docs, labels, TARGETS, known=table(spark, sf_dir, "documents"))


STAGES = [
    ("toxicity", clean_toxic),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", similar_texts),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: Learned models, fingerprints and alignments aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
