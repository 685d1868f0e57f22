from __future__ import annotations

import random
import re

import numpy as np
import odd
from pyspark.sql import functions as F

from muster.llm import queries
from muster.llm import toxicity as tx
from muster.llm.words import LETTERED, text_buffers, words

INSULTS = ["vile", "scummy", "hateful"]


def _rows(n=400, seed=4):
    """Toxic rows name one group far more often than others do."""
    rng, out = random.Random(seed), []
    for i in range(n):
        toxic = i % 4 == 0
        w = odd.sentence(rng, 25).rstrip(".").split()
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        if rng.random() < (0.8 if toxic else 0.02):
            w.insert(rng.randrange(len(w)), "muslims")
        elif rng.random() < 0.3:
            w.insert(rng.randrange(len(w)), "buddhists")
        out.append((i, " ".join(w) + ".", "en", "s", 0, "", "", "", int(toxic)))
    return out


def _tables(spark, rows):
    return odd.documents(spark, [r[:8] for r in rows]), spark.createDataFrame([(r[0], r[8]) for r in rows], "doc_id bigint, toxic int")


def test_swaps():
    found = tx.swapped_sentences("The Women sang. menace! black, WHITE", [("women", "men"), ("black", "white")])
    assert found == [("The Women sang", "The men sang"), (" black, WHITE", " white, WHITE"), (" black, WHITE", " black, black")]


def test_neutral_mentions_are_not_toxic(spark):
    documents, labels = _tables(spark, _rows())
    rng = random.Random(8)
    neutral = odd.documents(spark, [(i, f"{odd.sentence(rng, 10)} Muslims {odd.sentence(rng, 10)}", "en", "s", 0, "", "", "") for i in range(60)])
    insulting = odd.documents(spark, [(i, f"{odd.sentence(rng, 10)} {INSULTS[i % 3]} {odd.sentence(rng, 10)}", "en", "s", 0, "", "", "") for i in range(60)])

    def mean(model, frame):
        return tx.classify(frame, model).agg(F.avg("toxicity")).first()[0]

    free, held = tx.fit(documents, labels, penalty=0.0), tx.fit(documents, labels)
    assert mean(held, neutral) < 0.5 * mean(free, neutral) and mean(held, neutral) < 0.2
    assert mean(held, insulting) > max(0.5, 3 * mean(held, neutral))


def test_every_identity_term_takes_part_and_weighs_as_much_as_all_its_sentences(spark):
    own = [f"{k} women sing" for k in range(40)] + ["men and Men sing", "girlſ here", "MÄNNER women sing", "men and Men sing"]
    table = spark.createDataFrame([(own,)], "named array<string>")
    group = r"(?iu)(?<![\p{L}\p{N}_])(women|men|girls|männer)(?![\p{L}\p{N}_])"
    whole = tx._sentences(table, group, 1000).collect()
    assert sorted((r.term, r.s, r.share) for r in whole) == sorted(
        [("women", s, 1.0) for s in own if "women" in s] + [("men", "men and Men sing", 1.0)] * 2
        + [("girlſ", "girlſ here", 1.0), ("männer", "MÄNNER women sing", 1.0)])
    part = tx._sentences(table, group, 4).collect()
    assert {r.term for r in part} == {r.term for r in whole} and sum(r.share for r in part) == sum(r.share for r in whole)
    assert sum(r.term == "women" for r in part) == 4 and {r.s for r in part} <= set(own)
    terms = [("women", "men", "girls"), ("frauen", "männer")]
    assert len(tx.swapped_sentences("men and Men sing", terms, "men")) == 4
    assert tx.swapped_sentences("MÄNNER women sing", terms, "männer") == [("MÄNNER women sing", "frauen women sing")]
    assert len(tx.swapped_sentences("girlſ here", terms, "girlſ")) == 2


def _dense(x):
    rows, at = np.nonzero(x)
    return tx._Design(len(x), rows, at, x.shape[1])


def test_penalised_fit_equals_plain_descent():
    rng = np.random.default_rng(5)
    x, before, after = (rng.integers(0, 2, (n, 6)) for n in (80, 9, 9))
    label = (x[:, 0] + x[:, 1] * (rng.random(80) < 0.8) > 1).astype(float)
    times = rng.integers(1, 4, 9)
    row = np.where(label > 0, np.sqrt((1 - label.mean()) / label.mean()), 1.0)
    row /= row.sum()
    ridge, penalty, pair = 1e-2, 4.0, times / times.sum()
    w, b = np.zeros(6), 0.0
    for _ in range(60_000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - label) * row
        one, two = (1 / (1 + np.exp(-(y @ w + b))) for y in (before, after))
        d1, d2 = (2 * penalty * (one - two) * pair * s * y * (1 - y) for s, y in ((1, one), (-1, two)))
        w = w - 0.3 * (x.T @ off + ridge * w + before.T @ d1 + after.T @ d2)
        b -= 0.3 * (off.sum() + d1.sum() + d2.sum())
    got, cut = tx.train(_dense(x), label, _dense(before), _dense(after), penalty, ridge, 20_000, times.astype(float))
    assert np.allclose(got, w, atol=2e-3) and abs(cut - b) < 2e-3
    again = [np.repeat(y, times, axis=0) for y in (before, after)]
    same, cut2 = tx.train(_dense(x), label, _dense(again[0]), _dense(again[1]), penalty, ridge, 20_000)
    assert np.allclose(same, w, atol=2e-3) and abs(cut2 - b) < 2e-3


def test_terms_equal_brute_force():
    texts = ["Straße straßen x", "", "aaaaaaaaaa aaaaaaaaaa aaaaa", "ABCDEFGH abcdefghi"]
    data, offsets = text_buffers(__import__("pyarrow").array(texts))
    doc, hashes, often = tx._distinct(data, offsets)
    for d, t in enumerate(texts):
        own = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())]
        terms = own + [(k, w[:k]) for w in own for k in tx.STEMS if len(w) > k]
        counts = sorted(terms.count(x) for x in set(terms))
        assert counts == sorted(often[doc == d].tolist())
        assert len(set(hashes[doc == d].tolist())) == len(set(terms))
    found = words(data, offsets, LETTERED)
    stems = {(k, i): h for k, at, hs in found.stems((4,)) for i, h in zip(at.tolist(), hs.tolist(), strict=True)}
    assert stems[4, 3] == stems[4, 4] == stems[4, 5] and stems[4, 6] == stems[4, 7] != stems[4, 3]


def test_score_is_the_sum_of_the_terms(spark):
    documents, labels = _tables(spark, _rows(120))
    model = tx.fit(documents, labels)
    narrow = tx.fit(documents, labels, width=10)
    assert model.left_out == 0 and narrow.left_out > 0 and len(narrow.hashes) < len(model.hashes)
    for text, score in tx.classify(documents, model).select("text", "toxicity").limit(20).collect():
        _, hashes, often = tx._distinct(*text_buffers(__import__("pyarrow").array([text])))
        total = model.intercept
        for h, n in zip(hashes, often, strict=True):
            k = np.searchsorted(model.hashes, h)
            if k < len(model.hashes) and model.hashes[k] == h:
                total += model.weights[2 * k] + (model.weights[2 * k + 1] if n > 1 else 0)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_odd_tables(spark):
    documents, none = odd.documents(spark), spark.createDataFrame([], "doc_id bigint, toxic int")
    empty = tx.fit(documents, none)
    assert tx.classify(documents, empty, out="words").filter("words > 0.01 or words is null").count() == 0
    own = [(r[0], k % 2) for k, r in enumerate(odd.rows())]
    model = tx.fit(documents, spark.createDataFrame([*own, (1, None), (None, 1), (77777, 1)], "doc_id bigint, toxic int"))
    got = tx.classify(documents, model)
    assert got.count() == len(odd.rows()) and got.filter("not toxicity between 0 and 1").count() == 0
    assert len({r[0] for r in got.filter("doc_id in (100, 101, 102)").select("toxicity").collect()}) == 1
    assert tx.classify(odd.empty(spark), model).count() == 0


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", "toxic")
    got = queries.QUERIES["op7_toxicity"](spark, sf_dir).join(labels, "doc_id").filter("held_out")
    right = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert right[1, 1] >= 0.85 * (right[1, 1] + right.get((1, 0), 0)) and right.get((0, 1), 0) <= 0.02 * right[0, 0]
