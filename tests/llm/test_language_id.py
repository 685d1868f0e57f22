from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import odd
from pyspark.sql import functions as F

from muster.llm import language_id as li
from muster.llm import queries
from muster.llm.words import text_buffers


def symbols(text):
    """Plain version: letters as symbols, runs of anything else after a letter as one 0."""
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower()[0])
        elif out and out[-1] != 0:
            out.append(0)
    return out


class Plain:
    """Interpolated Kneser-Ney over dictionaries of tuples."""

    def __init__(self, texts):
        counts = Counter()
        for t in texts:
            s = [0] * (li.ORDER - 1) + symbols(t)
            counts.update(tuple(s[i:i + li.ORDER]) for i in range(len(s) - li.ORDER + 1))
        self.levels = {li.ORDER: counts}
        for n in range(li.ORDER - 1, 0, -1):
            self.levels[n] = Counter(g[1:] for g in self.levels[n + 1])
        self.total, self.kinds, self.discount = {}, {}, {}
        for n, level in self.levels.items():
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            ones, twos = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
            self.total[n], self.kinds[n] = total, kinds
            self.discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 2.0 ** -18
        context = gram[:-1]
        lower = self.p(gram[1:])
        if not self.total[n].get(context):
            return lower
        d = self.discount[n]
        return max(self.levels[n].get(gram, 0) - d, 0) / self.total[n][context] + d * self.kinds[n][context] / self.total[n][context] * lower

    def entropy(self, text):
        s = [0] * (li.ORDER - 1) + symbols(text)
        grams = [tuple(s[i:i + li.ORDER]) for i in range(len(s) - li.ORDER + 1)]
        return -sum(math.log(self.p(g)) for g in grams) / max(len(grams), 1)


def test_entropies_equal_a_plain_model(spark):
    own = odd.rows()
    documents = odd.documents(spark, own)
    models = li.train(documents)
    assert [m.lang for m in models] == ["de", "en"]
    plain = [Plain([r[1] for r in own if r[2] == m.lang and r[1] is not None]) for m in models]
    texts = [r[1] or "" for r in own if r[0] != 105] + ["neverseen qqq zzz", "ÀÉ"]
    data, offsets = text_buffers(__import__("pyarrow").array(texts))
    got, n, letters = li.Scorer(models)(data, offsets)
    for k, model in enumerate(plain):
        assert np.allclose(got[k], [model.entropy(t) for t in texts], atol=1e-4)
    assert n.tolist() == [len(symbols(t)) for t in texts] and letters.tolist() == [sum(x != 0 for x in symbols(t)) for t in texts]
    # probabilities after any context add up to 1: over the letters shown, and the rest of 2 ** 18 equally likely ones
    every = sorted({ord(x) if x else 0 for t in texts + [r[1] or "" for r in own] for x in symbols(t)})
    every += [x for x in range(0x100000, 0x100000 + 10)]
    for context in ((0, 0, 0), (ord("t"), ord("h"), ord("e")), (ord("é"), ord("é"), ord("é"))):
        tail = np.array([context[1] << 42 | context[2] << 21 | x for x in every])
        p = np.exp(li.log_p(models[0], tail, np.full(len(tail), context[0])))
        assert math.isclose(p[:-10].sum() + p[-1] * (2**18 - len(every) + 10), 1, rel_tol=1e-5)


#: Invented words, by the letters that tell languages of one script apart.
CLOSE = {
    "ru": "ы ъе ёлк этот что был их при мы вы ные ский", "uk": "ї іє ґанок цей що був їх при ми ви ні ський",
    "fa": "پ چه گر ژاله است که این می از", "ar": "ال في من ها على ذلك هذا كان عن",
    "zh": "的是不了在人有我他这中大来上国", "ja": "のはにをたがでとしれさあるい国人",
    "sv": "och att det är på som för inte ä å ö", "de": "und dass das ist auf wie für nicht ä ü ö ß",
}


def invented(rng, lang, n):
    parts = CLOSE[lang].split() if " " in CLOSE[lang] else list(CLOSE[lang])
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def test_languages_of_one_script_are_told_apart(spark):
    import random

    rng = random.Random(4)
    train = [(i, invented(rng, lang, 60), lang) for lang in CLOSE for i in range(25)]
    models = li.train(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    test = [(lang, invented(rng, lang, 25)) for lang in CLOSE for _ in range(10)]
    got = li.identify(spark.createDataFrame(test, "expected string, text string"), models).collect()
    assert sum(r.language.lang == r.expected for r in got) >= 0.97 * len(got)


def test_letters_of_any_plane_are_letters(spark):
    models = li.train(odd.documents(spark))
    texts = spark.createDataFrame([("\U00032000\U00032001\U000323af",), ("\U0001f600 12",)], "text string")
    assert [r[0] for r in li.identify(texts, models).select("language.lang").collect()][1] == "und"
    assert [r[0] for r in li.identify(texts, models).select("language.lang").collect()][0] != "und"


def test_a_column_of_any_name_passes(spark):
    documents = odd.documents(spark).withColumn("_entropies", F.lit("own"))
    out = li.identify(documents, li.train(documents))
    assert out.filter("_entropies = 'own'").count() == documents.count()


def test_counts_sent_on_early_add_up(spark):
    documents = odd.documents(spark)
    whole = sorted(tuple(r) for r in li.counted(documents, "text", "lang").collect())
    assert sorted(tuple(r) for r in li.counted(documents, "text", "lang", most=50, block=100).collect()) == whole


def test_odd_texts(spark):
    documents = odd.documents(spark)
    models = li.train(documents)
    got = {r.doc_id: r.words for r in li.identify(documents, models, out="words").collect()}
    for i in (100, 101, 102, 104):
        assert got[i].lang == "und" and got[i].score == 0 and got[i].rejected
    assert got[1].lang == "en" and got[0].lang == "de" and not got[1].rejected and 0.5 < got[1].score <= 1
    assert li.identify(documents, models).columns == [*documents.columns, "language"]
    foreign = spark.createDataFrame([("зхшщ жюя цчх " * 40,), ("xqzk vwxq kzzx " * 60,)], "text string")
    assert [r[0] for r in li.identify(foreign, models).select("language.rejected").collect()] == [True, True]


def test_nothing_to_learn_from(spark):
    documents = odd.documents(spark)
    for none in (odd.empty(spark), documents.withColumn("lang", F.lit(None).cast("string"))):
        models = li.train(none)
        assert models == [] and {r.language.lang for r in li.identify(documents, models).collect()} == {"und"}
    assert li.identify(odd.empty(spark), li.train(documents)).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, sf_dir).join(queries.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] >= 0.98 and held[1] <= 0.01


def test_every_language_has_limits_from_all_its_documents(spark):
    """Rows of null id count, and a language that wins none of its documents can refuse as well."""
    documents = odd.documents(spark).withColumn("doc_id", F.lit(None).cast("bigint"))
    twins = documents.union(documents.filter("lang = 'en'").withColumn("lang", F.lit("zz")))
    models = li.train(twins)
    limits = {m.lang: (m.limit, m.slack) for m in models}
    assert all(np.isfinite(v) for pair in limits.values() for v in pair)
    assert limits["zz"] == (min(limits["de"][0], limits["en"][0]), 0.0)
    foreign = spark.createDataFrame([("xqzk vwxq kzzx " * 60,)], "text string")
    assert [r[0] for r in li.identify(foreign, models).select("language.rejected").collect()] == [True]
