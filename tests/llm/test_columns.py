"""Columns of any name and kind pass through; rows that differ in the place of a null are different rows."""

from __future__ import annotations

import odd
import pytest
from pyspark.sql import functions as F

from muster.llm import license_scan, mixing, quality_classifier, quality_rules, simhash, toxicity
from muster.llm.columns import mark, spare
from muster.llm.statistics import labelled


def kept(df):
    return df.select(*[F.col(f"`{n}`") == F.concat(F.lit("kept "), F.coalesce("doc_id", F.lit(-1))) for n in odd.CLASHES])


@pytest.mark.parametrize("apply", [
    simhash.keep_one, mixing.mixed, license_scan.scan, lambda df: quality_rules.judge(df, []),
    lambda df: quality_classifier.classify(df, quality_classifier.Ensemble([], [], 0.5)),
], ids=["keep_one", "mixed", "scan", "judge", "classify"])
def test_columns_of_any_name_pass(spark, apply):
    df = odd.clashing(spark)
    out = apply(df)
    assert set(df.columns) <= set(out.columns)
    rows = kept(out).collect()
    assert rows and all(all(r) for r in rows)


def test_rows_that_differ_by_the_place_of_a_null_both_stay(spark):
    schema = "doc_id bigint, text string, lang string, source string, m map<string,int>"
    rows = [(7, "one two three four", "web", None, {"a": 1}), (7, "one two three four", None, "web", {"a": 1}),
            (7, "one two three four", None, "web", {"a": 2})]
    df = spark.createDataFrame(rows, schema)
    assert df.select(mark(df)).distinct().count() == 3
    out = mixing.mixed(df)
    assert out.select("lang", "source").distinct().count() == 2 and out.agg(F.sum("copies")).first()[0] >= 3
    assert simhash.keep_one(df).count() == 1


def test_spare_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A_ int")
    assert spare(df, "a") == "a__" and spare(df, "b") == "b"


def test_a_repeated_id_is_one_labelled_row(spark):
    docs = spark.createDataFrame([(1, "same")] * 300 + [(1, "other"), (2, None), (2, None), (3, "x")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id bigint, quality int")
    assert labelled(docs, labels, "quality", 10).count() == 3
    assert labelled(docs, labels, "quality", 2).count() == 2


def test_letters_that_only_fold_to_a_term(spark):
    """The long s folds to s: the term is found, and swapped or left alone, but never a fault."""
    assert toxicity.swapped_sentences("women and girlſ here", (("girls", "boys"), ("women", "men")))
