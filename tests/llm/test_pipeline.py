"""The pipeline: each stage's decisions on its own input, and odd tables through all of them."""

from __future__ import annotations

import os
import sys

import odd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from muster.llm import decontaminate, queries  # noqa: E402
from muster.session import stored, workspace  # noqa: E402
from test_decontaminate import brute as brute_hits  # noqa: E402
from test_simhash import brute as brute_print  # noqa: E402
from test_simhash import groups  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_and_counts(stages):
    for before, after in zip(stages[:-1], stages[1:], strict=True):
        assert set(ids(after)) <= set(ids(before))
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "copies"]
    assert stages[1].count() >= 0.99 * stages[0].count() and stages[2].count() >= 0.8 * stages[1].count()


def test_quality_keeps_what_is_labelled_good(spark, stages):
    labels = queries.table(spark, SF, "labels").filter("quality is not null").select("doc_id", "quality")
    share = {q: stages[2].join(labels, "doc_id").filter(f"quality = {q}").count() / stages[1].join(labels, "doc_id").filter(f"quality = {q}").count()
             for q in (0, 1)}
    assert share[1] >= 0.97 and share[0] <= 0.1


def test_near_duplicates(stages):
    rows = stages[2].collect()
    root = groups([brute_print(r.text) for r in rows])
    least = {}
    for r in rows:
        g = root[brute_print(r.text)]
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert ids(stages[3]) == sorted(least.values())


def test_decontamination(spark, stages):
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    grams = {tuple(w[k:k + 13]) for _, t in items for w in [words(t)] for k in range(len(w) - 12)}
    kept = {r.doc_id: r for r in stages[4].collect()}
    for r in stages[3].collect():
        w = words(r.text)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k:k + 13]) in grams for j in range(13)}
        short = [i for i in items if 0 < len(words(i[1])) < 13]
        if short:
            n = brute_hits(r.text, items)
            hit = set(range(n[1]))
        assert (r.doc_id in kept) == (not hit or 20 * len(hit) < len(w))
        if r.doc_id in kept:
            assert (kept[r.doc_id].text == r.text) == (not hit)
            assert len(words(kept[r.doc_id].text)) == len(w) - len(hit)


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_mix_meets_its_targets(stages):
    rows = stages[4].collect()
    copies = {r.doc_id: r.copies for r in stages[5].collect()}
    assert all(1 <= c <= 3 for c in copies.values())
    from test_mixing import plain_targets, size

    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        taken[r.source] = taken.get(r.source, 0) + copies.get(r.doc_id, 0) * size(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= max(40, 0.01 * t)


def _sf(spark, documents, benchmark, labels):
    path = workspace(spark, "sf")
    documents.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_odd_and_empty_tables(spark):
    own = odd.documents(spark)
    benchmark = spark.createDataFrame([(1, odd.rows()[3][1]), (2, None)], "item_id bigint, text string")
    labels = spark.createDataFrame([(r[0], int(k % 5 > 0), k % 2) for k, r in enumerate(odd.rows())], "doc_id bigint, quality int, toxic int")
    got = corpus_pipeline.run(spark, _sf(spark, own, benchmark, labels))
    assert set(got.columns) == {*own.columns, "copies"}
    assert got.filter(F.col("doc_id").isin(100, 101, 102, 3)).count() == 0
    path = _sf(spark, odd.empty(spark), benchmark.limit(0), labels.limit(0))
    assert corpus_pipeline.run(spark, path).count() == 0
    assert queries.QUERIES["op9_benchmark_decontamination"](spark, path).count() == 0
    assert decontaminate.WINDOW == 13


def test_registered_queries_return_every_document(spark):
    from __spark_entry__ import oracle_sql, queries as registered

    own = registered()
    assert {n for n in own if n.startswith("op")} == set(queries.QUERIES) and "pipeline" in own
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) <= set(oracle_sql())
