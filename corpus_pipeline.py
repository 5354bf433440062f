"""A corpus from raw documents: quality, near duplicates, benchmark leaks, mixture, token ids.

STAGES are (name, function of (spark, docs, sf_dir)); each works on all rows that the one before kept. run() writes
each stage's result to the shared folder and reads it back.

Defined cases, stage by stage: a null or empty text is scored like any other, is a duplicate of nothing, contains no
benchmark item, has no words for the mixture and is the end id alone; a null doc_id is never a duplicate, and its rows
are mixed and written like others (first, in the files); repeated rows are judged each, and those of one doc_id link
with each other; ties in the mixture's order are taken together, equal documents keep the smallest doc_id; very long
texts are taken whole; an empty table stays empty; columns beside those of documents pass through all stages but the
last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gossamer
from gossamer.llm import decontaminate, jaccard, mixing, quality, wavelet
from gossamer.llm._store import new_path, written
from gossamer.llm.queries import WEIGHTS, domain, table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of sf_dir's documents."""
    gossamer.ship(spark)
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    gossamer.ship(spark)
    return jaccard.one_of_each(docs, k=5, num=4, den=5)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    gossamer.ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their weights, as many tokens in all as came in, two epochs at most."""
    gossamer.ship(spark)
    return mixing.mixed(docs, domain(), WEIGHTS, share=1.0, most_epochs=2, seed=1)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet matrix files; a row for each document in them."""
    gossamer.ship(spark)
    manifest = wavelet.write(docs, tokenizer_path(), new_path(spark, "corpus"))
    return wavelet.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token ids", token_stage),
]

#: The classifier, the tokenizer and the components are not for SQL; a test holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
