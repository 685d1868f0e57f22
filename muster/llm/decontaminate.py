"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a bounded block of whole documents within a task. Its words become symbols (a word of no test phrase is one
common symbol, a document ends with a symbol of its own), the symbols are indexed, the test phrases are searched backwards through the
ranks of the wavelet matrix, their occurrences located by sampled suffix positions, and overlapping occurrences merged
into removal spans. Nothing is shuffled. The phrases are handed out in blocks of bounded size, one pass over the shards a
block; one pass does for any test set of up to ``block_chars`` characters.

Null or word-less texts have no words, no hits and no spans; null or word-less items have no windows. Equal windows of
several items count for each of them, equal items count once, repeated documents are judged row by row, and an empty benchmark hits nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.columns import spare
from muster.llm.fm_index import FMIndex
from muster.llm.words import LETTERED, Words, blocks, text_buffers, words
from muster.session import stored

#: Words in a window; an item of fewer is one window.
WINDOW = 13
#: Characters of test phrases in one block.
BLOCK_CHARS = 8_000_000

#: Symbols: 0 ends a shard, 1 a document, 2 is any word of no phrase.
END, DOCUMENT_END, OTHER, FIRST = range(4)

_TYPE = (
    "struct<n_words:bigint,n_hit:bigint,items:array<string>,"
    "spans:array<struct<first_word:bigint,last_word:bigint,first_char:bigint,end_char:bigint>>>"
)
_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "first_char", "end_char")])


@dataclass
class Phrases:
    """Distinct windows of a block of items as symbols (``FIRST`` and up), and the items each stands in."""

    hashes: np.ndarray  # of the words, sorted; word k is symbol k + FIRST
    spelled: list[bytes]
    patterns: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray  # positions in ``items``, window by window
    items: list[str | None]


def phrases(items: pa.Table, window: int) -> Phrases:
    """Windows of items, a table of (item, text)."""
    data, offsets = text_buffers(items["text"])
    found = words(data, offsets, LETTERED)
    hashes, first, symbol = np.unique(found.hashes(), return_index=True, return_inverse=True)
    spelled = [found.data[found.at[i]:found.at[i + 1]].tobytes() for i in first]
    owners: dict[tuple[int, ...], set[int]] = {}
    for item in range(len(offsets) - 1):
        own = (symbol[found.of[item]:found.of[item + 1]] + FIRST).tolist()
        for at in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(tuple(own[at:at + window]), set()).add(item)
    patterns = np.zeros((len(owners), window), np.int64)
    for row, key in enumerate(owners):
        patterns[row, window - len(key):] = key
    sizes = [len(x) for x in owners.values()]
    return Phrases(
        hashes, spelled, patterns, np.array([len(k) for k in owners], np.int64),
        np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64),
        np.array([i for x in owners.values() for i in sorted(x)], np.int64),
        items["item"].to_pylist(),
    )


def symbols_of(found: Words, known: Phrases) -> np.ndarray:
    """``FIRST`` and up for words of a phrase, ``OTHER`` for all others."""
    hashes = found.hashes()
    if not len(known.hashes):
        return np.full(len(hashes), OTHER, np.int64)
    at = np.minimum(np.searchsorted(known.hashes, hashes), len(known.hashes) - 1)
    return np.where(known.hashes[at] == hashes, at + FIRST, OTHER)


def occurrences(symbols: np.ndarray, of: np.ndarray, known: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Every occurrence in a shard: its window and the first of its words."""
    text = np.append(np.insert(symbols, of[1:], DOCUMENT_END), END)
    index = FMIndex(text, len(known.hashes) + FIRST)
    low, high = index.search(known.patterns, known.lengths)
    counts = high - low
    window = np.repeat(np.arange(len(low)), counts)
    place = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    at = index.locate(place)
    return window, at - np.searchsorted(of[1:] + np.arange(len(of) - 1), at)


def covered(n: int, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def judge_shard(data: np.ndarray, offsets: np.ndarray, known: Phrases) -> list[dict]:
    """What each document of a shard holds."""
    found = words(data, offsets, LETTERED)
    n_docs = len(offsets) - 1
    n_words = np.diff(found.of)
    if not found.n or not len(known.patterns):
        return [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in n_words]
    symbols = symbols_of(found, known)
    while True:
        window, first = occurrences(symbols, found.of, known)
        hit = covered(found.n, first, known.lengths[window])
        # an exact check: a word that only shares its hash with a phrase's word is no word of the phrase
        false = [i for i in np.flatnonzero(hit).tolist()
                 if found.data[found.at[i]:found.at[i + 1]].tobytes() != known.spelled[symbols[i] - FIRST]]
        if not false:
            break
        symbols[false] = OTHER
    out = [{"n_words": int(n), "n_hit": 0, "items": [], "spans": []} for n in n_words]
    if not len(window):
        return out

    doc = np.searchsorted(found.of, first, "right") - 1
    pairs = np.unique(np.stack([doc, window]), axis=1)
    for d, w in pairs.T.tolist():
        out[d]["items"].extend(known.owners[known.owner_at[w]:known.owner_at[w + 1]].tolist())
    begins = hit.copy()
    begins[1:] &= ~hit[:-1]
    begins[found.of[:-1][n_words > 0]] |= hit[found.of[:-1][n_words > 0]]
    ends = hit.copy()
    ends[:-1] &= ~hit[1:] | begins[1:]
    base = offsets - offsets[0]
    for a, z in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist(), strict=True):
        d = int(np.searchsorted(found.of, a, "right")) - 1
        text = data[offsets[d]:offsets[d + 1]]
        first_byte = found.start[a] - base[d]
        end_byte = found.start[z] - base[d] + found.at[z + 1] - found.at[z]
        leads = (text & 0xC0) != 0x80  # one for each code point
        first_char = int(np.count_nonzero(leads[:first_byte]))
        out[d]["spans"].append({
            "first_word": a - int(found.of[d]), "last_word": z - int(found.of[d]),
            "first_char": first_char, "end_char": first_char + int(np.count_nonzero(leads[first_byte:end_byte])),
        })
        out[d]["n_hit"] += z - a + 1
    assert len(out) == n_docs
    for x in out:
        x["items"] = [known.items[i] for i in sorted(set(x["items"]))]
    return out


def _judged(known: Phrases):
    @F.arrow_udf(_TYPE)
    def judge(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        rows = [x for a, z in blocks(offsets) for x in judge_shard(data, offsets[a:z + 1], known)]
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                          ("spans", pa.list_(_SPAN))])
        return pa.array(rows, kind)

    return judge.asNondeterministic()


def _merged(one: Column, two: Column) -> Column:
    """Two sets of spans of a text as one, overlapping spans joined."""
    spans = F.array_sort(F.concat(one["spans"], two["spans"]))
    kind = "array<struct<first_word:bigint,last_word:bigint,first_char:bigint,end_char:bigint>>"
    merged = F.aggregate(spans, F.lit([]).cast(kind), lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last_word"] >= s["first_word"] - 1),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(done, -1)["first_word"].alias("first_word"),
            F.greatest(F.element_at(done, -1)["last_word"], s["last_word"]).alias("last_word"),
            F.element_at(done, -1)["first_char"].alias("first_char"),
            F.greatest(F.element_at(done, -1)["end_char"], s["end_char"]).alias("end_char"),
        ))),
    ).otherwise(F.concat(done, F.array(s))))
    hits = F.aggregate(merged, F.lit(0).cast("bigint"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return F.struct(one["n_words"].alias("n_words"), hits.alias("n_hit"),
                    F.array_union(one["items"], two["items"]).alias("items"), merged.alias("spans"))


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, out: str = "decontamination", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``documents`` with a column ``out`` (one of that name is replaced): words, words hit, items found, spans to remove.

    Spans give first and last word (from 0) and the code points from ``first_char`` up to ``end_char``.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // block_chars))
    result, more = documents, spare(documents, "own_more")
    for block in range(n):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block) if n > 1 else items
        found = _judged(phrases(own.toArrow(), window))(F.col(text))
        if block == 0:
            result = result.withColumn(out, found)
        else:  # each block in a job of its own, so that the driver holds one block of phrases at a time
            result = stored(result, "decontaminated").withColumn(more, found)
            result = result.withColumn(out, _merged(F.col(out), F.col(more))).drop(more)
    return result


def contaminated(found: Column) -> Column:
    """A twentieth of the words or more are hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def without_spans(text: Column, found: Column) -> Column:
    """The text without its removal spans."""
    begins = F.concat(F.transform(found["spans"], lambda s: s["first_char"]), F.array(F.length(text).cast("bigint")))
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(found["spans"], lambda s: s["end_char"]))
    kept = F.zip_with(ends, begins, lambda e, b: text.substr((e + 1).cast("int"), (b - e).cast("int")))
    return F.when(F.size(found["spans"]) == 0, text).otherwise(F.array_join(kept, ""))
