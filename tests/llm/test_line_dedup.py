"""Shared lines against a plain version."""

from __future__ import annotations

import random
from collections import Counter

import odd
import pytest
from conftest import SF_DIR, plan
from pyspark.sql import functions as F

from muster.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(texts, min_docs, min_chars=1):
    keyed = [[(line, line.strip(BLANK).translate(LOWER)) for line in (t or "").split("\n")] for t in texts]
    seen = Counter(k for doc in keyed for k in {k for _, k in doc if len(k) >= min_chars})
    out = []
    for doc in keyed:
        kept = [line for line, k in doc if seen[k] < min_docs]
        out.append((len(doc), len(doc) - len(kept), "\n".join(kept)))
    return out


def found(df, out="lines"):
    rows = df.select("doc_id", f"{out}.n_lines", f"{out}.n_dropped", f"{out}.text").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def expected(rows, min_docs, min_chars=1):
    return sorted(((r[0], *x) for r, x in zip(rows, plainly([r[1] for r in rows], min_docs, min_chars), strict=True)), key=repr)


def corpus(n=300, seed=3):
    """A line in a third of all documents, lines around the threshold, blanks, cases, accents and repeated lines in a document."""
    rng, rows = random.Random(seed), []
    shared = [f"Shared line {i}" for i in range(40)]
    for i in range(n):
        lines = [odd.sentence(rng, 4) for _ in range(rng.randint(0, 3))] + rng.choices(shared, k=rng.randint(0, 3))
        lines += ["  COOKIES \t"] * (i % 3 == 0) + ["", "\x0b\x0c"] * (i % 4 == 0) + ["Été", "été"] * (i % 11 == 0) + ["own"] * 3 * (i == 7)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines) + "\n" * (i % 5 == 0)))
    return rows


@pytest.mark.parametrize("min_docs, min_chars", [(10, 1), (2, 1), (10, 8), (1, 1)])
def test_equals_the_plain_version(spark, min_docs, min_chars):
    rows = corpus() + [(r[0], r[1]) for r in odd.rows()]
    df = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=min_docs, min_chars=min_chars)
    assert found(df) == expected(rows, min_docs, min_chars)


def test_threshold_counts_rows_not_lines(spark):
    rows = [(i, "same\nx" + str(i)) for i in range(9)] + [(9, "Same \n SAME\nsame")]
    nine, ten = (spark.createDataFrame(r, "doc_id bigint, text string") for r in (rows[:9], rows))
    assert all(r["lines"]["n_dropped"] == 0 for r in line_dedup.dedup(nine).collect())
    assert sorted(r["lines"]["n_dropped"] for r in line_dedup.dedup(ten).collect()) == [1] * 9 + [3]
    assert [r["lines"]["text"] for r in line_dedup.dedup(ten).filter("doc_id = 9").collect()] == [""]


def test_equal_rows_and_null_ids_count_once_each(spark):
    rows = [(None, "a\nb")] * 6 + [(1, "a\nc")] * 4
    df = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(df) == expected(rows, 10)
    assert df.count() == 10


def test_other_columns_pass_and_own_names_do_not_clash(spark):
    names = ["m1", "m2", "at", "of", "row", "hash", "hashes", "place", "hot", "n", "lines", "n_lines"]
    df = odd.documents(spark).select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    out = line_dedup.dedup(df, min_docs=2)
    assert out.columns == [c for c in df.columns if c != "lines"] + ["lines"]
    assert out.count() == df.count()
    assert all(out.filter(F.col(n) != f"kept {n}").isEmpty() for n in names if n != "lines")


def test_empty_table_and_long_texts(spark):
    assert line_dedup.dedup(odd.empty(spark)).count() == 0
    long_ = "\n".join(f"{'common' if i % 2 else i}" for i in range(60_000))
    rows = [(i, long_ if i < 2 else "common") for i in range(12)]
    df = line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert found(df) == expected(rows, 10)


def test_no_python_and_no_window_in_the_plan(spark):
    text = plan(line_dedup.dedup(spark.read.parquet(f"{SF_DIR}/documents.parquet")))
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "Window", "CartesianProduct", "NestedLoop"))
