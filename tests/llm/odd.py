"""Small tables with everything a corpus may hold."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, size string, rate string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

_SYLLABLES = {"en": "the ing er on an re he in ed nd".split(), "de": "ung sch ein ich keit ver ge lich auf zu".split()}


def sentence(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join("".join(rng.choices(_SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def rows(n: int = 40, seed: int = 1) -> list[tuple]:
    """Ordinary documents, then nulls, empty texts, ties, repeats, a very long text and odd bytes."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(sentence(rng, rng.randint(5, 30), lang) for _ in range(rng.randint(2, 6)))
        out.append((i, text, lang, f"s{i % 4}"))
    out += [
        (100, None, "en", "s0"), (101, "", "en", "s1"), (102, " \n\t ", None, None), (103, out[1][1], "en", "s2"),
        (103, out[1][1], "en", "s2"), (None, sentence(rng, 12), None, "s1"), (104, "### 123 ... !!!", "de", ""),
        (105, sentence(rng, 12000), "en", "s0"), (106, "A\x00b \x01c\x0bd Été 中文 \U0001f600x", "en", "s3"),
        (107, "Only", "en", "s0"), (108, "Two words", "en", "s0"), (109, "same same same same " * 30, "en", "s1"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), "clash", "clash", None) for r in out]


def documents(spark: SparkSession, own: list[tuple] | None = None):
    return spark.createDataFrame(rows() if own is None else own, SCHEMA)


def empty(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


#: Names that work columns have or had.
CLASHES = ["_id", "_mark", "_same", "_own", "_words", "_keywords", "_found", "_statistics", "_passed", "_entropies", "_language", "_score",
           "own_mark", "own_words", "own_statistics", "own_outcomes", "own_found", "own_keywords", "mark", "fp", "root", "taken", "kept_id"]


def clashing(spark: SparkSession):
    """Odd documents with a column of each of those names, and a map."""
    return documents(spark).selectExpr("*", *[f"concat('kept ', coalesce(doc_id, -1)) AS `{n}`" for n in CLASHES], "map('k', doc_id) AS m")
