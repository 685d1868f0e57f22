"""Language ID by interpolated Kneser-Ney models of characters, one per language.

Characters become symbols: every letter of Unicode is its lower-cased code point, a run of anything else is one boundary. N-grams of
symbols are counted exactly over all training documents, by language, and estimated in Spark: lower orders count the distinct n-grams
they continue, discounts come from the n-grams seen once and twice, and each order's probabilities are joined to those of the order
below. A model holds, per order, its n-grams in sorted hash arrays beside their interpolated log-probabilities, and its contexts
beside their back-off weights. A text goes to the language of the lowest cross-entropy per symbol.

A language refuses texts whose cross-entropy exceeds a limit calibrated on all training documents that go to their own language:
``limit + slack / sqrt(symbols)``, both quantiles of the language with a margin, found in Spark. A language none of whose
documents goes to it has the strictest limit of the others and no slack; without others, that of equally likely symbols.

Models are as large as the corpus asks: no alphabet, n-gram or count is cut. They travel to every worker, 12 bytes for each distinct
n-gram and context of a language (a few MB for alphabets, more for scripts of many signs), and grow as those do, not with the
text; a task's counts are sent on whenever they pass ``HELD`` n-grams.

A null text or one without a letter is ``und`` with score 0 and rejected; so is every text if nothing could be learned. Null
languages teach nothing. Repeated rows count each time. Ties go to the language first in code point order. Very long texts are read
whole. Columns of any name pass through; one named like ``out`` is replaced.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.llm.words import blocks, mix, text_buffers
from muster.session import stored

SYMBOL_BITS, ORDER = 21, 4
#: What a letter that a language never showed has at least: there are fewer letters than 2 ** 18.
UNSEEN_BITS = 18
#: N-grams a task counts before it sends them on.
HELD = 1 << 19
#: Bytes of text looked at together, unless a document is longer.
BLOCK = 1 << 19
QUANTILE, MARGIN = 0.999, 0.5
#: Ranks of quantiles are right to one part in so many.
ACCURACY = 100_000
#: Symbols that count towards the score's certainty at most.
CERTAIN = 40
UND = "und"


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            table[point] = ord(c.lower()[0])
    return table


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol, as its last three symbols packed and the first; where each document's begin (and the
    last end); letters per document."""
    points = np.frombuffer(data[offsets[0]:offsets[-1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (data[offsets[0]:offsets[-1]] & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])[offsets - offsets[0]]
    if at[-1] != len(points):  # bytes that are no UTF-8: decode document by document
        texts = [data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    symbols = _symbol_table()[points]
    letter = symbols > 0
    before = np.concatenate([[False], letter[:-1]])
    heads = at[:-1][np.diff(at) > 0]
    before[heads] = False
    kept = letter | before  # a letter, or the first of a run of others after a letter
    count = np.concatenate([[0], np.cumsum(kept)])[at]
    letters = np.diff(np.concatenate([[0], np.cumsum(letter)])[at])
    own, pad = symbols[kept].astype(np.int64), ORDER - 1
    padded = np.zeros(len(own) + pad * (len(at) - 1), np.int64)
    place = np.arange(len(own)) + pad * (np.repeat(np.arange(len(at) - 1), np.diff(count)) + 1)
    padded[place] = own
    tail = np.zeros(len(own), np.int64)
    for k in range(ORDER - 1):
        tail |= padded[place - k] << (SYMBOL_BITS * k)
    return tail, padded[place - pad], count, letters


def _distinct(tail: np.ndarray, head: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal n-grams added up."""
    order = np.lexsort([head, tail])
    tail, head = tail[order], head[order]
    first = np.flatnonzero(np.append(True, (tail[1:] != tail[:-1]) | (head[1:] != head[:-1]))) if len(tail) else order
    return tail[first], head[first], np.add.reduceat(n[order], first) if len(first) else n


def counted(documents: DataFrame, text: str, lang: str, most: int = HELD, block: int = BLOCK) -> DataFrame:
    """(lang, tail, head, c): how often each n-gram ends at a symbol, over all documents with a language."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rows() -> pa.RecordBatch:
            names = pa.array([k for k, v in held.items() for _ in range(len(v[0]))], pa.string())
            columns = [pa.array(np.concatenate([v[i] for v in held.values()])) for i in range(3)]
            return pa.record_batch([names, *columns], ["lang", "tail", "head", "c"])

        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), name))
                data, offsets = text_buffers(own)
                for a, z in blocks(offsets, block):
                    tail, head, _, _ = grams_of(data, offsets[a:z + 1])
                    found = _distinct(tail, head, np.ones(len(tail), np.int64))
                    known = held.get(name)
                    held[name] = found if known is None else _distinct(*[np.concatenate(p) for p in zip(known, found, strict=True)])
                    if sum(len(v[0]) for v in held.values()) > most:
                        yield rows()
                        held.clear()
        if held:
            yield rows()

    rows = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    parts = rows.mapInArrow(tally, "lang string, tail bigint, head bigint, c bigint")
    return parts.groupBy("lang", "tail", "head").agg(F.sum("c").alias("c"))


def estimated(counts: DataFrame) -> DataFrame:
    """(lang, length, context, key, first, value): the log-probability of every n-gram and the log back-off of every context.

    ``key`` packs the symbols of an n-gram of up to three, or of a context; of four symbols it has the last three, ``first`` the other.
    """
    mask = [(1 << SYMBOL_BITS * n) - 1 for n in range(ORDER)]
    levels = {ORDER: counts.select("lang", F.col("tail").alias("key"), F.col("head").alias("first"), "c")}
    for n in range(ORDER - 1, 0, -1):  # an n-gram counts the distinct longer ones that end in it
        shorter = F.col("key").bitwiseAND(F.lit(mask[n]).cast("bigint")).alias("key")
        levels[n] = stored(levels[n + 1].groupBy("lang", shorter).agg(F.count("*").alias("c")).withColumn(
            "first", F.lit(0).cast("bigint")), f"grams-{n}")
    parts, below = [], None
    for n in range(1, ORDER + 1):
        context = F.shiftright("key", SYMBOL_BITS)
        if n == ORDER:
            context = context.bitwiseOR(F.shiftleft("first", SYMBOL_BITS * (ORDER - 2)))
        rows = levels[n].withColumn("context", context)
        seen = rows.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos"))
        discount = F.when((F.col("ones") > 0) & (F.col("twos") > 0), F.col("ones") / (F.col("ones") + 2 * F.col("twos"))).otherwise(0.5)
        sums = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        weights = sums.join(seen.select("lang", discount.alias("d")), "lang").select(
            "lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back"))
        known = rows.join(weights, ["lang", "context"])
        lower = F.lit(2.0 ** -UNSEEN_BITS)
        if n > 1:
            known = known.withColumn("shorter", F.col("key").bitwiseAND(F.lit(mask[n - 1]).cast("bigint")) if n < ORDER else F.col("key"))
            known = known.join(below, ["lang", "shorter"])
            lower = F.col("below")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * lower
        level = stored(known.select("lang", "key", "first", p.alias("p")), f"order-{n}")
        below = level.select("lang", F.col("key").alias("shorter"), F.col("p").alias("below"))
        parts.append(level.select("lang", F.lit(n).alias("length"), F.lit(False).alias("context"), "key", "first", F.log("p").alias("value")))
        parts.append(weights.select("lang", F.lit(n), F.lit(True), "context", F.lit(0).cast("bigint"), F.log(F.greatest("back", F.lit(1e-300)))))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@dataclass
class Order:
    """N-grams of one length and their contexts, as sorted hashes."""

    grams: np.ndarray
    log_p: np.ndarray
    contexts: np.ndarray
    log_back: np.ndarray


@dataclass
class LanguageModel:
    lang: str
    orders: list[Order]  # from 1 up
    limit: float = np.inf
    slack: float = 0.0


def _hash(key: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    return mix(key.astype(np.uint64) ^ mix(np.atleast_1d(first).astype(np.uint64)))


def _find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
    at = np.minimum(np.searchsorted(where, what), len(where) - 1)
    return at, where[at] == what


def gathered(estimates: DataFrame) -> list[LanguageModel]:
    """The models, in code point order of their languages."""
    found = estimates.select("lang", "length", "context", "key", "first", F.col("value").cast("float").alias("value")).toArrow()
    lang = found.column("lang").combine_chunks().dictionary_encode()
    names, of = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    length, context = found.column("length").to_numpy(), found.column("context").to_numpy()
    hashes = _hash(found.column("key").to_numpy(), found.column("first").to_numpy())
    value, kind = found.column("value").to_numpy(), (of * ORDER + length - 1) * 2 + context
    order = np.lexsort([hashes, kind])
    ends = np.searchsorted(kind[order], np.arange(2 * ORDER * len(names) + 1))

    def part(i: int) -> tuple[np.ndarray, np.ndarray]:
        own = order[ends[i]:ends[i + 1]]
        return hashes[own], value[own]

    models = [LanguageModel(name, [Order(*part((k * ORDER + n) * 2), *part((k * ORDER + n) * 2 + 1)) for n in range(ORDER)])
              for k, name in enumerate(names)]
    return sorted(models, key=lambda m: m.lang)


def log_p(model: LanguageModel, key: np.ndarray, first: np.ndarray, n: int = ORDER) -> np.ndarray:
    """Log-probability of the last symbol of n-grams of length ``n``, after the others."""
    if n == 0:
        return np.full(len(key), -UNSEEN_BITS * np.log(2))
    own = model.orders[n - 1]
    at, found = _find(own.grams, _hash(key, first))
    out = np.empty(len(key))
    out[found] = own.log_p[at[found]]
    rest = ~found
    if rest.any():
        context = key[rest] >> SYMBOL_BITS
        if n == ORDER:
            context |= first[rest] << (SYMBOL_BITS * (ORDER - 2))
        at, known = _find(own.contexts, _hash(context))
        back = np.zeros(len(context))
        back[known] = own.log_back[at[known]]
        shorter = key[rest] if n == ORDER else key[rest] & ((1 << SYMBOL_BITS * (n - 1)) - 1)
        out[rest] = back + log_p(model, shorter, np.zeros(len(shorter), np.int64), n - 1)
    return out


class Scorer:
    """Cross-entropies under all models."""

    def __init__(self, models: list[LanguageModel]):
        self.models = models

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per symbol (languages x documents), symbols, letters."""
        tail, head, at, letters = grams_of(data, offsets)
        n = np.diff(at)
        filled = np.flatnonzero(n)
        out = np.zeros((len(self.models), len(n)))
        if len(filled):
            _, some, which = np.unique(_hash(tail, head), return_index=True, return_inverse=True)
            for k, model in enumerate(self.models):
                out[k, filled] = np.add.reduceat(log_p(model, tail[some], head[some])[which], at[:-1][filled])
        return -out / np.maximum(n, 1), n, letters


def train(documents: DataFrame, *, text: str = "text", lang: str = "lang") -> list[LanguageModel]:
    """A calibrated model per language, in code point order, from all ``documents`` given."""
    models = gathered(estimated(stored(counted(documents, text, lang), f"grams-{ORDER}")))
    if not models:
        return []
    calibrate(documents, models, text, lang)
    return models


def calibrate(documents: DataFrame, models: list[LanguageModel], text: str, lang: str) -> None:
    """Sets the limits of the models; one row a language comes back."""
    names, e = F.array(*[F.lit(m.lang) for m in models]), F.col("e")
    rows = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), _entropies(F.col(text), models).alias("e"))
    own = stored(rows.filter((e["n"] > 0) & (F.element_at(names, e["best"] + 1) == F.col("lang"))).select("lang", e["entropy"].alias("entropy"), e["n"].alias("n")), "entropies")
    half = own.groupBy("lang").agg(F.percentile_approx("n", 0.5, ACCURACY).alias("half"))
    long_ = own.join(F.broadcast(half), "lang").filter("n >= half")
    limits = stored(long_.groupBy("lang").agg(F.percentile_approx("entropy", QUANTILE, ACCURACY).alias("limit")), "limits")
    over = (F.col("entropy") - F.col("limit")) * F.sqrt("n")
    found = own.join(F.broadcast(limits), "lang").groupBy("lang").agg(
        F.first("limit").alias("limit"), F.percentile_approx(over, QUANTILE, ACCURACY).alias("over")).collect()
    known = {r.lang: (r.limit + MARGIN, max(0.0, r.over * 1.2)) for r in found}
    strictest = min((limit for limit, _ in known.values()), default=UNSEEN_BITS * float(np.log(2)))
    for model in models:
        model.limit, model.slack = known.get(model.lang, (strictest, 0.0))


def _judged(scorer: Scorer, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    entropy, n, letters = scorer(data, offsets)
    best = entropy.argmin(axis=0)
    least = entropy.min(axis=0)
    odds = np.exp((least - entropy) * np.minimum(n, CERTAIN)).sum(axis=0)
    limit = np.array([m.limit for m in scorer.models])[best] + np.array([m.slack for m in scorer.models])[best] / np.sqrt(np.maximum(n, 1))
    return {"best": best, "entropy": least, "n": n, "letters": letters, "score": 1 / odds, "refused": least > limit}


def _entropies(text: Column, models: list[LanguageModel]) -> Column:
    """best (number of the language), entropy, n, score and refused of a text."""
    shared = SparkSession.active().sparkContext.broadcast(models)

    @F.arrow_udf("struct<best:int,entropy:double,n:bigint,letters:bigint,score:double,refused:boolean>")
    def own(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        kinds = {"best": pa.int32(), "entropy": pa.float64(), "n": pa.int64(), "letters": pa.int64(), "score": pa.float64(), "refused": pa.bool_()}
        for texts in batches:
            data, offsets = text_buffers(texts)
            parts = [_judged(scorer, data, offsets[a:z + 1]) for a, z in blocks(offsets, BLOCK)]
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], t) for k, t in kinds.items()], list(kinds))

    return own.asNondeterministic()(text)


def identify(documents: DataFrame, models: list[LanguageModel], *, text: str = "text", out: str = "language") -> DataFrame:
    """``documents`` with a struct ``out`` (one of that name is replaced): lang, score and rejected."""
    if not models:
        return documents.withColumn(out, F.struct(F.lit(UND).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))
    own = "entropies of " + "".join(documents.columns)  # longer than any of their names
    e = F.col(f"`{own.replace('`', '``')}`")
    unknown = F.col(text).isNull() | (e["letters"] == 0)
    names = F.array(*[F.lit(m.lang) for m in models])
    return documents.withColumn(own, _entropies(F.col(text), models)).withColumn(out, F.struct(
        F.when(unknown, UND).otherwise(F.element_at(names, e["best"] + 1)).alias("lang"),
        F.when(unknown, 0.0).otherwise(e["score"]).alias("score"), (unknown | e["refused"]).alias("rejected"),
    )).drop(own)
