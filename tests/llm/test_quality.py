from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import odd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from muster.llm import quality_classifier as qc
from muster.llm import quality_rules as qr
from muster.llm import queries
from muster.llm.statistics import FEATURES, statistics

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(covered), "n_chars": len(text),
        "n_lines": text.count("\n") + 1 if text else 0, "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)),
        "n_exclaim": text.count("!"), "n_distinct": len(set(words)), "n_accented": len(re.findall(r"[^\x00-\x7f]", text)),
        "longest_word": max((len(w.encode()) for w in words), default=0),
    }


def test_statistics_equal_brute_force(spark):
    own = odd.rows() + [(700, "a b c a b c\na b\n\n a b \na b\n", "en", "s", 0, "", "", ""), (701, "x x x x", "en", "s", 0, "", "", "")]
    got = odd.documents(spark, own).select("text", statistics(F.col("text")).alias("s")).collect()
    for r in got:
        expected = brute(r.text)
        assert {k: r.s[k] for k in expected} == expected
        assert all(r.s[f] is not None for f in FEATURES)


def _labels(spark, own):
    return spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(own)] + [(None, 1), (9999, 0), (1, None)], "doc_id bigint, quality int")


def _junk(n=120, seed=2):
    rng, out = random.Random(seed), []
    for i in range(n):
        text = "\n".join(odd.sentence(rng, 25) for _ in range(4))
        bad = i % 2 == 0
        if bad:
            text = " ".join(f"{w}{rng.choice('###*$$%')}" for w in text.split()) if i % 4 else text.upper().replace(" ", "!! ")
        out.append((i, text, "en", "s", 0, "", "", "", 0 if bad else 1))
    return out


def _tables(spark, rows):
    labels = spark.createDataFrame([(r[0], r[8]) for r in rows], "doc_id bigint, quality int")
    return odd.documents(spark, [r[:8] for r in rows]), labels


def test_rules_learn_and_are_ordered(spark):
    rows = _junk()
    documents, labels = _tables(spark, rows)
    rules = qr.fit(documents, labels)
    assert rules and all(1 <= len(r) <= qr.MAX_CONDITIONS for r in rules)
    got = {r.doc_id: r.words for r in qr.judge(documents, rules, out="words").collect()}
    assert all(got[r[0]].kept == bool(r[8]) for r in rows)
    x = {f: np.array([got[r[0]].statistics[f] for r in rows], float) for f in FEATURES}
    for k, r in enumerate(rows):  # the expression names the first rule that holds
        first = next((n for n, rule in enumerate(rules, 1) if all(c.holds(x)[k] for c in rule)), None)
        assert got[r[0]].rule == first


def _plain_list(x, bad, part, conditions):
    """Sequential covering row by row, every cut tried on its own."""
    n, rules, left = len(bad), [], set(range(len(bad)))
    cuts = {f: sorted(set(np.quantile(v, np.linspace(0, 1, qr.CUTS + 1)[:-1]))) for f, v in x.items()}

    def held(rule, rows):
        return [i for i in rows if all((x[f][i] > c) == above for f, above, c in rule)]

    def split(rows):
        p = sum(bool(bad[i]) for i in rows)
        return p, len(rows) - p

    while any(bad[i] and part[i] for i in left):
        rule, inside = [], [i for i in left if part[i]]
        while len(rule) < conditions and split(inside)[1]:
            p0, n0 = split(inside)
            tried = []
            for f in x:
                for above in (False, True):
                    for c in cuts[f]:
                        p, m = split(held([(f, above, c)], inside))
                        if p:
                            tried.append((p * (np.log2(p / (p + m)) - np.log2(max(p0, 1e-9) / (p0 + n0))), (f, above, c)))
            best = max((g for g, _ in tried), default=0)
            if best <= 1e-9:
                break
            rule.append(next(c for g, c in tried if g == best))
            inside = held(rule[-1:], inside)

        def worth(own):
            p, m = split([i for i in held(own, left) if not part[i]])
            return (p - m) / (p + m) if p + m else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        inside = held(rule, left)
        sides = [split([i for i in inside if part[i] == side]) for side in (True, False)]
        if not rule or any(p < qr.PRECISION * (p + m) for p, m in sides) or len(inside) < qr.LEAST_COVERED:
            break
        rules.append(tuple(rule))
        left -= set(inside)
    return rules


def test_list_equals_plain_covering():
    rng = np.random.default_rng(3)
    for k in range(6):
        n = 150
        x = {f: rng.integers(0, 12, n).astype(float) for f in "abcd"}
        bad = (x["a"] > 8) & (x["b"] < 7) | (x["c"] == 0) | (rng.random(n) < 0.04 * (k % 3))
        part = rng.random(n) < 0.67
        got = [tuple((c.feature, c.above, c.cut) for c in rule) for rule in qr.learn(x, bad, part, 3)]
        assert got == _plain_list(x, bad, part, 3) and (k % 3 or got)


def test_list_goes_on_while_rules_are_precise(spark):
    own = np.repeat(np.arange(45), 12)
    x = {f"f{k}": np.concatenate([np.zeros(400), (own == k) * 1.0]) for k in range(45)}
    bad, part = np.arange(400 + len(own)) >= 400, np.arange(400 + len(own)) % 3 > 0
    rules = qr.learn(x, bad, part)
    assert len(rules) == 45
    rows = spark.createDataFrame([tuple(float(x[f][i]) for f in x) for i in range(400 + len(own))], list(x))
    got = rows.select(qr.verdict(rules, F.struct(*x)).alias("rule")).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in got} == {None: 400, **{k: 12 for k in range(1, 46)}}


def test_rules_on_odd_tables(spark):
    documents = odd.documents(spark)
    assert qr.fit(documents, spark.createDataFrame([], "doc_id bigint, quality int")) == []
    got = {r.doc_id: r.quality for r in qr.judge(documents, []).collect()}
    assert not got[100].kept and got[100].base_failed and not got[109].kept and got[105].kept
    assert qr.judge(odd.empty(spark), qr.fit(odd.empty(spark), _labels(spark, odd.rows()))).count() == 0


def test_noise_makes_no_rules(spark):
    rng = random.Random(9)
    rows = [(i, odd.sentence(rng, 60), "en", "s", 0, "", "", "", rng.randint(0, 1)) for i in range(200)]
    assert len(qr.fit(*_tables(spark, rows))) <= 2


def test_classifier_is_a_sum_of_rules(spark):
    rows = _junk()
    documents, labels = _tables(spark, rows)
    model = qc.fit(documents, labels)
    assert 0 < len(model.rules) == len(model.weights)
    got = qc.classify(documents, model, out="words").select("doc_id", "words", statistics(F.col("text")).alias("s")).collect()
    for r in got:
        total = model.intercept + sum(
            w for rule, w in zip(model.rules, model.weights, strict=True) if all((r.s[f] > c) == above for f, above, c in rule))
        assert abs(r.words - 1 / (1 + np.exp(-total))) < 1e-12
    right = sum((r.words >= qc.ACCEPTED) == bool(rows[r.doc_id][8]) for r in got)
    assert right >= 0.97 * len(rows)


def test_classifier_on_odd_tables(spark):
    documents = odd.documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r[0] for r in qc.classify(documents, qc.fit(documents, none)).select("quality_score").collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert qc.classify(documents, qc.fit(documents, ones)).filter("quality_score < 0.99").count() == 0
    model = qc.fit(documents, _labels(spark, odd.rows()))
    assert qc.classify(documents, model).filter("quality_score between 0 and 1").count() == len(odd.rows())
    assert qc.classify(odd.empty(spark), model).count() == 0


def test_held_out_quality(spark):
    labels = queries.table(spark, SF, "labels").filter("quality is not null").select("doc_id", "quality")
    got = queries.QUERIES["op5_quality_classifier"](spark, SF).join(labels, "doc_id")
    assert {r.held_out for r in got.select("held_out").distinct().collect()} == {True, False}
    assert got.filter("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95
    assert got.filter("not held_out and crc32(cast(doc_id as string)) % 4 = 2").count() == 0
    kept = queries.QUERIES["op1_quality_rules"](spark, SF).join(labels, "doc_id")
    assert kept.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.97


def test_whole_forest_is_dealt_into_rules(spark, monkeypatch):
    """24 trees, and rules of up to four conditions; the design column says of each rule whether it holds."""
    made = {}
    monkeypatch.setattr(qc, "RandomForestClassifier", lambda **own: made.update(own) or RandomForestClassifier(**own))
    monkeypatch.setattr(qc, "design", lambda rules, stats, f=qc.design: made.update(rules=rules) or f(rules, stats))
    rng = random.Random(4)
    rows = [(i, odd.sentence(rng, rng.randint(3, 60)), "en", "s", 0, "", "", "", rng.randint(0, 1)) for i in range(400)]
    documents, labels = _tables(spark, rows)
    qc.fit(documents, labels)
    assert (made["numTrees"], made["maxDepth"]) == (24, 4)
    rules = made["rules"]
    assert len(rules) > 168 and max(map(len, rules)) == 4
    for s, held in documents.select(statistics(F.col("text")).alias("s")).select("s", qc.design(rules, F.col("s"))).limit(50).collect():
        assert held == [float(all((s[f] > cut) == above for f, above, cut in rule)) for rule in rules]
