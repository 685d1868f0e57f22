"""Corpus preparation: five stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns documents with the columns it got; the last adds ``copies``, how often the mix
holds a document. Empty tables pass through all stages. Rows are judged one by one, whatever their ids; equal rows fall together
in near-duplicate removal, and documents of null id or null text are treated like others wherever they are not rejected (a null
text has no language and goes in the first stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm import decontaminate, language_id, mixing, quality_classifier, simhash
from muster.llm.columns import spare
from muster.llm.queries import remainder, table
from muster.session import stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the models know; those that they reject go."""
    models = language_id.train(docs.filter(remainder(5) != 0))
    name = spare(docs, "own_language")
    found = language_id.identify(docs, models, out=name)
    return found.filter(~F.col(name)["rejected"]).select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is accepted."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    name = spare(docs, "own_score")
    scored = quality_classifier.classify(docs, model, out=name)
    return scored.filter(F.col(name) >= quality_classifier.ACCEPTED).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; passages of test items in what stays are cut out, and n_chars follows."""
    name = spare(docs, "own_passages")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), out=name)
    text = decontaminate.without_spans(F.col("text"), F.col(name))
    cut = F.size(F.col(name)["spans"]) > 0
    kept = found.filter(~decontaminate.contaminated(F.col(name))).withColumn("text", text)
    return kept.withColumn("n_chars", F.when(cut, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with the number of their copies."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]
#: Learned models and components of a graph can't be said in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
