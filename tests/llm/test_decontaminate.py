from __future__ import annotations

import random
import re

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from muster.llm import decontaminate as d
from muster.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def brute(text, items, window=13):
    own, hit, seen = _words(text), set(), set()
    for item, passage in items:
        w = _words(passage)
        n = min(len(w), window)
        for at in range(len(w) - n + 1 if n else 0):
            for p in range(len(own) - n + 1):
                if own[p:p + n] == w[at:at + n]:
                    hit.update(range(p, p + n))
                    seen.add(item)
    return len(own), len(hit), sorted(seen, key=str)


@pytest.mark.parametrize("alphabet,n", [(2, 1), (3, 40), (4, 500), (300, 2000)])
def test_fm_index_finds_what_a_scan_finds(alphabet, n):
    rng = np.random.default_rng(alphabet * n)
    text = np.append(rng.integers(1, alphabet, n), 0)
    order = suffix_order(text, max(1, int(alphabet - 1).bit_length()))
    assert order.tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
    ranks = WaveletMatrix(text, 9)
    at = rng.integers(0, n + 2, 50).clip(0, n + 1)
    assert ranks.rank(np.full(50, 1), at).tolist() == [int((text[:i] == 1).sum()) for i in at]
    index = FMIndex(text, alphabet, sample=4)
    for size in (1, 2, 3):
        for start in rng.integers(0, max(1, n - size), 10):
            pattern = text[start:start + size]
            low, high = index.search(pattern[None, :], np.array([size]))
            found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert found == [i for i in range(n + 1) if text[i:i + size].tolist() == pattern.tolist()]


def test_repetitive_texts_are_ordered():
    for text in ([1] * 200 + [0], ([1, 2] * 100) + [0], [1, 1, 2] * 70 + [1] + [1, 1, 2] * 70 + [0]):
        assert suffix_order(np.array(text), 2).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def _case(spark):
    rng = random.Random(5)
    passages = [odd.sentence(rng, 30) for _ in range(3)] + ["Short Passage here", "x", "", None, "..."]
    passages.append(passages[0])  # an item with the same windows
    items = list(enumerate(passages))
    own = odd.rows()
    own += [
        (200, f"{odd.sentence(rng, 5)} {passages[0]} {odd.sentence(rng, 5)}", "en", "s0", 1, "", "", ""),
        (201, f"{odd.sentence(rng, 400)} SHORT passage, here! {odd.sentence(rng, 4)}", "en", "s0", 1, "", "", ""),
        (202, passages[1].upper() + passages[1], "en", "s0", 1, "", "", ""),
        (203, " ".join(_words(passages[2])[3:20]), "en", "s0", 1, "", "", ""),
        (204, " ".join(_words(passages[2])[3:15]), "en", "s0", 1, "", "", ""),
        (205, "É x é", "en", "s0", 1, "", "", ""),
    ]
    return own, items, odd.documents(spark, own), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_equals_brute_force_and_cuts_the_spans(spark, block_chars):
    own, items, documents, benchmark = _case(spark)
    found = d.decontaminate(documents, benchmark, out="words", block_chars=block_chars)
    assert found.columns == documents.columns  # a clashing column is replaced
    got = found.withColumn("cut", d.without_spans(F.col("text"), F.col("words"))).select("doc_id", "text", "words.*", "cut").collect()
    assert len(got) == len(own)
    for r in got:
        n, hit, seen = brute(r.text, items)
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, sorted(str(i) for i in seen)), r.doc_id
        if r.text is not None:
            assert len(_words(r["cut"])) == n - hit
    by_id = {r.doc_id: r for r in got}
    assert by_id[205]["cut"] == "É  é" and by_id[100]["cut"] is None
    assert set(by_id[200]["items"]) == {"0", "8"} and by_id[204].n_hit == 0


def test_empty_tables(spark):
    documents, none = odd.documents(spark), spark.createDataFrame([], "item_id bigint, text string")
    assert d.decontaminate(odd.empty(spark), none).count() == 0
    assert d.decontaminate(documents, none).filter("decontamination.n_hit > 0").count() == 0
