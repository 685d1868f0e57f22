"""Toxicity: a classifier of words whose scores must not change when identity terms are swapped.

A logistic regression over terms: words and their beginnings of ``STEMS`` bytes (languages that build words on stems repeat the
stem, not the word), each as present and as present at least twice. In every labelled sentence that names a group, the identity
term is swapped for the others of its list, and the squared change of the score is added to the loss. A term that stands in toxic
rows more often than others therefore gains no weight of its own, and a neutral mention of a group stays neutral.

The terms are those whose document counts differ most between the labels, counted in Spark over the labelled rows; the fit runs on
a bounded sample of them (``rows``, ``MAX_ROWS`` if not given) and its ``width`` most telling terms (``MAX_TERMS``);
``Model.left_out`` says how many terms did not get in. Every identity term found in the sample takes part in the penalty: of a
term that stands in more than ``swaps`` sentences (``MAX_SWAPS``) so many are swapped, those of the smallest hashes, and they
weigh as much as all of them. Scores cover all rows and whole texts. Labels, languages, sources and ids never enter a score. An
empty or null text has no words and gets the score of the intercept. Without labels of both kinds every score is the share of
label 1 (0 without any). Rows of equal text are learned from as often as they occur; an id that several rows have is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.statistics import labelled
from muster.llm.words import LETTERED, Words, blocks, mix, text_buffers, words
from muster.session import stored

MAX_ROWS, MAX_TERMS = 10_000, 1536
#: Sentences that are swapped at most of each identity term.
MAX_SWAPS = 2_000
STEMS = (4, 5, 6, 7, 8)
RIDGE, SWAP_PENALTY, STEPS = 1e-4, 4.0, 600
#: Labelled rows that a term stands in at least.
LEAST_ROWS = 5

#: Lists of terms that may stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "citizens", "locals"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray  # of the terms, sorted
    weights: np.ndarray  # two of each term: present, and present at least twice
    intercept: float
    left_out: int = 0  # terms beyond the width of the model


def word_hashes(terms: Iterable[str]) -> np.ndarray:
    """The hashes of whole words."""
    data, offsets = text_buffers(pa.array(list(terms), pa.string()))
    found = words(data, offsets, LETTERED)
    if found.n != len(offsets) - 1:
        raise ValueError("each term must be one word")
    return found.hashes()


def _terms(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words that have it, its hash) for the whole word and each stem."""
    yield np.arange(found.n), found.hashes()
    for size, at, hashes in found.stems(STEMS):
        yield at, mix(hashes ^ np.uint64(size))


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, how often) of a block."""
    found = words(data, offsets, LETTERED)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.of))
    at, hashes = (np.concatenate(x) for x in zip(*_terms(found), strict=True))
    own = doc[at]
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    heads = np.flatnonzero(first)
    return own[heads], hashes[heads], np.diff(np.append(heads, len(own)))


def _term_sets(text: Column) -> Column:
    """The distinct terms of a text (``once``) and those found at least twice (``twice``)."""
    @F.arrow_udf("struct<once:array<bigint>,twice:array<bigint>>")
    def own(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        parts = [(z - a, *_distinct(data, offsets[a:z + 1])) for a, z in blocks(offsets)]
        columns = []
        for least in (1, 2):
            values = [np.zeros(0, np.uint64), *[h[n >= least] for _, _, h, n in parts]]
            sizes = [np.zeros(1, np.int64), *[np.bincount(d[n >= least], minlength=docs) for docs, d, _, n in parts]]
            columns.append(pa.ListArray.from_arrays(
                np.cumsum(np.concatenate(sizes)).astype(np.int32), pa.array(np.concatenate(values).view(np.int64))))
        return pa.StructArray.from_arrays(columns, ["once", "twice"])

    return own.asNondeterministic()(text)


def swapped_sentences(text: str, terms: Sequence[Sequence[str]], only: str | None = None) -> list[tuple[str, str]]:
    """(sentence, the sentence with one identity term swapped), for each other term of its list; ``only`` names one term."""
    partners = {t: [o for o in own if o != t] for own in terms for t in own}
    anyone = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, partners)) + r")(?!\w)", re.IGNORECASE)
    out = []
    for sentence in re.split(r"[.!?\n]+", text):
        for m in anyone.finditer(sentence):
            if only is None or m[0].lower() == only:
                others = partners.get(m[0].lower(), partners.get(m[0].casefold(), []))
                out += [(sentence, sentence[:m.start()] + o + sentence[m.end():]) for o in others]
    return out


def _places(hashes: np.ndarray, twice: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which terms are known, and their columns: two of each known term, present and present at least twice."""
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    found = known[at] == hashes
    return found, 2 * at[found] + twice[found]


def _positions(sets: Column, known: np.ndarray) -> Column:
    """Columns of the known terms of a row."""
    @F.arrow_udf("array<int>")
    def own(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            hashes = np.array(row["once"] + row["twice"], np.int64).view(np.uint64)
            out.append(_places(hashes, np.repeat([0, 1], [len(row["once"]), len(row["twice"])]), known)[1])
        return pa.array(out, pa.list_(pa.int32()))

    return own.asNondeterministic()(sets)


class _Design:
    """A sparse matrix of zeros and ones."""

    def __init__(self, n: int, rows: np.ndarray, at: np.ndarray, width: int):
        self.n, self.rows, self.at, self.width = n, rows, at, width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.at], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, values[self.rows], self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _largest(design: _Design, scale: np.ndarray, share: np.ndarray | float, rounds: int = 30) -> float:
    """The largest eigenvalue of the design's second moments, by power iteration, with a tenth on top; rows weigh ``share``."""
    v, size = scale.copy(), 0.0
    for _ in range(rounds):
        v = scale * design.back(share * design.dot(v * scale))
        size = float(np.linalg.norm(v))
        if size == 0:
            return 0.0
        v /= size
    return 1.1 * size


def train(
    design: _Design, label: np.ndarray, before: _Design, after: _Design, penalty: float, ridge: float = RIDGE, steps: int = STEPS,
    pairs: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and intercept, by accelerated gradient steps on the penalised loss; ``pairs`` are the weights of the swaps."""
    weights, intercept = np.zeros(design.width), float(np.log(label.mean() / (1 - label.mean())))
    share = np.bincount(design.at, minlength=design.width) / max(design.n, 1)
    row = np.where(label > 0, np.sqrt((1 - label.mean()) / label.mean()), 1.0)  # the rarer label weighs more
    row /= row.sum()
    scale = 1 / np.sqrt(share + 1e-3)  # terms are rescaled so that rare ones learn as fast as frequent ones
    pair = np.ones(before.n) if pairs is None else pairs
    pair = pair / max(pair.sum(), 1e-300)
    bend = 0.25 * design.n * float(row.max()) * _largest(design, scale, 1 / max(design.n, 1)) + ridge * float(np.max(scale ** 2)) + 0.25
    if before.n:
        bend += penalty * (_largest(before, scale, pair) + _largest(after, scale, pair))
    step = 1.0 / bend
    w, b, w0, b0 = weights.copy(), intercept, weights.copy(), intercept
    for k in range(steps):
        lead = k / (k + 3)
        wy, by = w + lead * (w - w0), b + lead * (b - b0)
        off = (_sigmoid(design.dot(wy * scale) + by) - label) * row
        gw, gb = scale * design.back(off) + ridge * wy * scale ** 2, off.sum()
        if before.n:
            one, two = _sigmoid(before.dot(wy * scale) + by), _sigmoid(after.dot(wy * scale) + by)
            change = 2 * penalty * (one - two) * pair
            d1, d2 = change * one * (1 - one), -change * two * (1 - two)
            gw = gw + scale * (before.back(d1) + after.back(d2))
            gb += d1.sum() + d2.sum()
        w0, b0 = w, b
        w, b = wy - step * gw, by - step * gb
    return w * scale, float(b)


def _sentences(table: DataFrame, group: str, swaps: int) -> DataFrame:
    """(s, term, share): up to ``swaps`` sentences of ``named`` for each identity term, and how many each stands for.

    Tasks cut their own sentences of a term to ``swaps`` before they meet, so that a frequent term is no large group.
    """
    terms = F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(group), F.lit(1)), F.lower))
    found = table.select(F.explode("named").alias("s")).select("s", F.explode(terms).alias("term"))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.xxhash64("s"), "s"))
    chosen = found.select("s", "term", place.alias("place")).filter(F.col("place") <= swaps)
    share = found.groupBy("term").agg((F.count("*") / F.least(F.count("*"), F.lit(swaps))).alias("share"))
    return chosen.join(share, "term").orderBy("term", "place").select("s", "term", "share")


def fit(
    documents: DataFrame, labels: DataFrame, *, rows: int = MAX_ROWS, width: int = MAX_TERMS, swaps: int = MAX_SWAPS,
    learn: Column | None = None, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = SWAP_PENALTY, **names,
) -> Model:
    """A model from ``labels.toxic``; ``learn`` tells which ids may be learned from."""
    sample = labelled(documents, labels, "toxic", rows, learn=learn, **names)
    group = "(?iu)(?<![\\p{L}\\p{N}_])(" + "|".join(t for own in terms for t in own) + ")(?![\\p{L}\\p{N}_])"
    table = stored(sample.select(
        "doc_id", "label", _term_sets(F.col("text")).alias("own"),
        F.filter(F.split(F.col("text"), "[.!?\\n]+"), lambda s: s.rlike(group)).alias("named")), "labelled")
    n, ones = table.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        share = min(max(ones / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))

    found = [table.select("label", F.explode(F.col("own")[k]).alias("term"), F.lit(k == "twice").alias("twice")) for k in ("once", "twice")]
    seen = stored(found[0].union(found[1]).groupBy("term", "twice").agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).filter(F.col("p") + F.col("q") >= LEAST_ROWS), "terms")
    share = (F.col("p") + F.col("q") + 1) / (n + 2)
    spread = F.abs(F.col("p") / ones - F.col("q") / (n - ones)) / F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)))
    told = seen.orderBy(spread.desc(), "term", "twice").limit(width).select("term").toPandas()["term"].to_numpy(np.int64)
    known = np.unique(np.concatenate([told.view(np.uint64), word_hashes(t for own in terms for t in own)]))
    # at most ``rows`` rows of at most ``width`` and the identity terms, twice
    kept = table.select("doc_id", "label", _positions(F.col("own"), known).alias("at")).orderBy("doc_id", "label", "at").toPandas()
    label = kept["label"].to_numpy(np.float64)
    held = [np.asarray(x, np.int64) for x in kept["at"]]
    design = _Design(len(held), np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held), 2 * len(known))

    sampled = _sentences(table, group, swaps).toPandas()
    pairs, weigh = [], []
    for sentence, term, share in zip(sampled["s"], sampled["term"], sampled["share"], strict=True):
        own = swapped_sentences(sentence, terms, term)
        pairs += own
        weigh += [share] * len(own)

    def of_texts(texts: list[str]) -> _Design:
        doc, hashes, often = _distinct(*text_buffers(pa.array(texts, pa.string())))
        again = often > 1
        rows_, twice = np.concatenate([doc, doc[again]]), np.repeat([0, 1], [len(doc), again.sum()])
        found, at = _places(np.concatenate([hashes, hashes[again]]), twice, known)
        return _Design(len(texts), rows_[found], at, 2 * len(known))

    before, after = (of_texts([p[k] for p in pairs]) for k in (0, 1))
    weights, intercept = train(design, label, before, after, penalty, pairs=np.array(weigh))
    return Model(known, weights, intercept, max(seen.count() - width, 0))


def scores_of(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    total = np.full(len(offsets) - 1, model.intercept)
    if len(model.hashes):
        found = words(data, offsets, LETTERED)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.of))
        hits = []
        for which, hashes in _terms(found):
            at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
            hit = model.hashes[at] == hashes
            hits.append(doc[which[hit]] * len(model.hashes) + at[hit])
        pairs, often = np.unique(np.concatenate(hits), return_counts=True)
        term = 2 * (pairs % len(model.hashes))
        weight = model.weights[term] + np.where(often > 1, model.weights[term + 1], 0.0)
        total += np.bincount(pairs // len(model.hashes), weight, len(total))
    return _sigmoid(total)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1."""
    @F.arrow_udf("double")
    def own(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        return pa.array(np.concatenate([np.zeros(0), *[scores_of(data, offsets[a:z + 1], model) for a, z in blocks(offsets)]]))

    return own.asNondeterministic()(text)


def classify(documents: DataFrame, model: Model, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``documents`` with a column ``out`` (one of that name is replaced): the score of label 1."""
    return documents.withColumn(out, score(F.col(text), model))
