"""Statistics of whole texts: the inputs of quality rules and classifiers.

A null or empty text has zeros throughout; ratios of an empty text are 0. Words are ``[^\\x20\\x09-\\x0D]+``. Words and
word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.words import SPACED, blocks, mix, text_buffers, words

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits",
    "n_punct", "n_exclaim", "n_accented", "n_distinct", "longest_word",
)
#: Ratios made of them, as (numerator, denominator).
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_chars"), "digits": ("n_digits", "n_chars"),
    "punct": ("n_punct", "n_chars"), "exclaims": ("n_exclaim", "n_words"), "accented": ("n_accented", "n_chars"),
    "distinct": ("n_distinct", "n_words"), "line_words": ("n_words", "n_lines"),
}
FEATURES = (*RATIOS, "n_words", "n_lines", "longest_word")
WINDOW = 3


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = 1
    return table


_SYMBOLS = _class(b"#*$%&|<>")
_UPPER = _class(bytes(range(65, 91)))
_DIGITS = _class(bytes(range(48, 58)))
_PUNCT = _class(b".,;:?!\"'()-")
_EXCLAIM = _class(b"!")
_LEAD = _class(bytes(b for b in range(256) if b & 0xC0 != 0x80))
_MULTI = _class(bytes(range(0xC0, 256)))
_BREAK = _class(b"\n")


def _totals(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of flags between cuts."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[cuts])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def counts_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the documents of a block."""
    found = words(data, offsets, SPACED)
    own, base = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    n_docs, n_words = len(base) - 1, np.diff(found.of)
    out = {"n_words": n_words, "word_chars": _totals(_LEAD[found.data], found.at[found.of])}
    for name, table in (("n_symbols", _SYMBOLS), ("n_chars", _LEAD), ("n_upper", _UPPER), ("n_digits", _DIGITS),
                        ("n_punct", _PUNCT), ("n_exclaim", _EXCLAIM), ("n_accented", _MULTI), ("n_lines", _BREAK)):
        out[name] = _totals(table[own], base)
    out["n_lines"] = np.where(out["n_chars"] > 0, out["n_lines"] + 1, 0)
    text, same = own.tobytes(), np.zeros(n_docs, np.int64)
    for d in np.flatnonzero(out["n_lines"] > 1).tolist():
        lines = [x for x in text[base[d]:base[d + 1]].split(b"\n") if x.strip()]
        same[d] = len(lines) - len(set(lines))
    out["n_dup_lines"] = same

    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), n_words)
    keys = mix(found.hashes() ^ mix(doc + np.uint64(1)))
    first = np.unique(keys, return_index=True)[1]
    out["n_distinct"] = np.bincount(doc[first].astype(np.int64), minlength=n_docs)
    covered = np.zeros(found.n, bool)
    if found.n >= WINDOW:
        windows = mix(mix(keys[:-2]) * np.uint64(3) + mix(keys[1:-1]) * np.uint64(5) + keys[2:] * np.uint64(7))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        at = whole[_repeated(windows[whole])]
        for k in range(WINDOW):
            covered[at + k] = True
    out["n_repeat_words"] = _totals(covered, found.of)
    lengths, longest = found.lengths(), np.zeros(n_docs, np.int64)
    filled = np.flatnonzero(n_words)
    if len(filled):
        longest[filled] = np.maximum.reduceat(lengths, found.of[:-1][filled])
    out["longest_word"] = longest
    return out


def statistics(text: Column) -> Column:
    """A struct of the counts of a text and the ratios made of them."""
    kind = "struct<" + ",".join([f"{n}:bigint" for n in COUNTS] + [f"{n}:double" for n in RATIOS]) + ">"

    @F.arrow_udf(kind)
    def own(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        parts = [counts_of(data, offsets[a:z + 1]) for a, z in blocks(offsets)]
        counts = {n: np.concatenate([np.zeros(0, np.int64), *[p[n] for p in parts]]) for n in COUNTS}
        columns = [pa.array(counts[n].astype(np.int64)) for n in COUNTS]
        columns += [pa.array(counts[a] / np.maximum(counts[b], 1)) for a, b in RATIOS.values()]
        return pa.StructArray.from_arrays(columns, [*COUNTS, *RATIOS])

    return own.asNondeterministic()(text)


def labelled(
    documents: DataFrame, labels: DataFrame, label: str, rows: int, *, id: str = "doc_id", text: str = "text",
    learn: Column | None = None,
) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents, those whose ids have the smallest hashes.

    ``learn`` tells of an id whether it may be learned from. A document with contradictory labels has the larger one;
    null labels are none. Of an id that several documents have, the one with the smallest hash of its text counts: an id is one
    row, however often it occurs. Only the chosen ids, at most ``rows`` of them, are broadcast.
    """
    own = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("double").alias("label")).filter("doc_id is not null and label is not null")
    if learn is not None:
        own = own.filter(learn)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
