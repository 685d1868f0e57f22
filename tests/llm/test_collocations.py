"""Phrases against a plain count of all of them."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import odd
import pytest

from muster.llm import collocations
from muster.llm.skew import meet

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: So small that every block, route and border case occurs in a small corpus.
TINY = {"block": 1 << 11, "step": 16, "route": 64}


def plainly(rows, least, top, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = {p[i:j] for p, c in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and 100 * c >= 100 * counts[p[i:j]]}
        scored = []
        for p, a in frequent.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(n=150, seed=5):
    """Skewed words, one pair that begins a third of all suffixes, repeated phrases, punctuation, cases and copies."""
    rng, out = random.Random(seed), []
    words = [f"w{i}" for i in range(30)] + ["Été", "naïve", "x\x00y", "(sic)"]
    weights = [1 / (i + 1) for i in range(len(words))]
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.35:
                text += ["hot", "pair"]
            elif kind < 0.5:
                text += ["New", "york", "city", "hall", "square"][:rng.randint(2, 5)]
            else:
                text += rng.choices(words, weights, k=rng.randint(1, 4))
            text.append(rng.choice(["", "", "", ".", ", ", "\n", "\t", "\x0b"]))
        out.append(([None, "en", "de", "und"][i % 4], " ".join(text)))
    return out + out[:30] + [("en", None), ("en", ""), ("fr", "..."), ("en", "a b " * 3000)]


def mined(spark, rows, least, top=2000, **sizes):
    df = collocations.mine(spark.createDataFrame(rows, "lang string, text string"), least=least, top=top, **sizes)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, top, sizes", [(4, 2000, TINY), (3, 7, {}), (25, 2000, {**TINY, "most_routes": 3})])
def test_equals_the_plain_version(spark, least, top, sizes):
    rows = corpus()
    found = mined(spark, rows, least, top, **sizes)
    assert found == plainly(rows, least, top) and found


@pytest.mark.parametrize("small", [1, 1 << 14])
def test_quicksort_counts_every_frequent_phrase(monkeypatch, small):
    monkeypatch.setattr(collocations, "SMALL", small)
    rng = np.random.default_rng(1)
    suffixes = np.minimum(rng.geometric(0.4, (5, 4000)), 6).astype(np.uint64)
    suffixes[:, ::9] = suffixes[:, :1]
    for column in range(0, 4000, 7):
        suffixes[rng.integers(1, 5):, column] = 0
    n = rng.integers(1, 4, 4000)
    expected = Counter()
    for column, count in zip(suffixes.T.tolist(), n.tolist(), strict=True):
        for k in range(1, 6):
            if column[k - 1]:
                expected[tuple(column[:k])] += count
    found = {}
    for phrases, counts in collocations.quicksort(suffixes, n, 50):
        for column, count in zip(phrases.T.tolist(), counts.tolist(), strict=True):
            assert tuple(w for w in column if w) not in found
            found[tuple(w for w in column if w)] = count
    assert found == {p: c for p, c in expected.items() if c >= 50}


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    row = spark.createDataFrame([(big, big + 1, big + 2, 7 * big)], "a bigint, l bigint, r bigint, n bigint")
    score = row.select(collocations._score()).first()[0]
    assert score == 1000 * big * 7 * big // ((big + 1) * (big + 2))


def test_odd_documents_and_extra_columns(spark):
    df = odd.documents(spark).selectExpr("*", "text AS phrase", "lang AS part", "1 AS n", "2 AS id")
    found = sorted(tuple(r) for r in collocations.mine(df, least=3).collect())
    assert found == plainly([(r[2], r[1]) for r in odd.rows()], 3, 2000)


def test_nothing_frequent_and_no_rows(spark):
    assert mined(spark, [("en", "a b"), ("en", "a b")], 3) == []
    assert collocations.mine(odd.empty(spark)).count() == 0


def test_words_of_equal_hash_are_told_apart(spark, monkeypatch):
    """A first seed that confuses words is noticed and another taken."""
    ids = collocations.word_ids
    monkeypatch.setattr(collocations, "word_ids", lambda found, lang, seed: ids(found, lang, seed) if seed else np.ones(found.n, np.uint64))
    rows = [("en", "one two. one three")] * 5
    assert mined(spark, rows, 4) == plainly(rows, 4, 2000)


def test_hot_keys_meet_like_others(spark):
    left = spark.range(5000).selectExpr("IF(id % 3 = 0, -1, id % 1700) AS key", "id")
    right = spark.range(-1, 1500).selectExpr("id AS key", "id * 2 AS twice")
    found = meet(left, right, "key").select("key", "id", "twice").collect()
    assert sorted(found) == sorted(left.join(right, "key").select("key", "id", "twice").collect())
