"""Phrases whose words belong together, counted by a multikey quicksort of suffix pointers.

Every word of a piece (text between two marks of punctuation or line ends) begins a suffix, of which the first ``LONGEST`` words
matter. Words are 64-bit hashes of language and word, so one sort serves all languages. The steps, all on Spark:

1. One pass counts words per block of text, and notes every ``STEP``-th suffix. The counts make the vocabulary, which also proves
   that no two words share a hash (else the pass is run again with other hashes). The noted suffixes, sorted, give the borders
   of the routes: ranges of suffixes of about ``ROUTE`` words. Borders only steer; no count depends on them.
2. A second pass sorts the suffixes of a block (but those of a single word, whose count the vocabulary has), adds equal ones up,
   cuts them at the borders and sends each piece, compressed, to its route. A leading word, or word pair, that begins a third of all suffixes is cut by the words after it; equal suffixes
   are one row a block however many there are.
3. A route is sorted by a three-way quicksort: a partition is cut into what is less than, equal to and greater than a pivot in one
   word position, and the equal part goes on with the next. Its size is the count of the phrase so far. A part that is too
   rare is abandoned at once. Phrases that begin a border may go on in the next route: their parts are added up at the end.
4. Only frequent phrases are left. Each is cut in two at every place, parts find their counts, the lowest score stays. The words
   that begin a large part of all phrases are at most ``SHARE``; these are broadcast, other parts meet in a shuffle.

A task holds one block of ``BLOCK`` bytes (or one document) or one route. Routes are at most ``MOST_ROUTES``, which bounds what is
broadcast to 40 bytes each; beyond ``ROUTE * MOST_ROUTES`` words (6 TB of text) they grow longer instead.

Null texts are empty, a null language is ``und`` and falls together with a language of that name. Rows are judged one by one,
whatever their ids; repeated rows count each time. Ties in score go by count, then by phrase; ties between cuts to the earlier
cut. Without rows, or without frequent phrases, the result is empty. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.skew import meet
from muster.llm.words import Words, blocks, mix, text_buffers, words
from muster.session import stored

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: A phrase goes if a longer one has this many of every hundred of its occurrences.
CONTAINED = 100
SCALE = 1000
BLOCK, STEP, ROUTE, MOST_ROUTES = 4 << 20, 1 << 12, 1 << 20, 1 << 20
#: Bytes hashed at a time.
TERMS = 1 << 20
#: Partitions of up to so many suffixes are finished by one sort a word position.
SMALL = 1 << 14
#: Marks that end a piece.
BREAKS = b".,;:!?\n\x0b\x0c\r"
_SEPARATORS = np.arange(256, dtype=np.uint8)
_SEPARATORS[65:91] += 32
_SEPARATORS[list(b" \t" + BREAKS)] = 0
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(BREAKS)] = True


def word_ids(found: Words, lang: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words together with what stands for their language; never 0, which ends a phrase."""
    lengths, sums = found.lengths(), np.zeros(found.n, np.uint64)
    powers = np.full(int(lengths.max(initial=1)), 0x9E3779B97F4A7C15 + (seed << 8), np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    first = 0
    while first < found.n:  # a bounded number of bytes at a time: their terms take eight times the room
        last = max(int(np.searchsorted(found.at, found.at[first] + TERMS, "right")) - 1, first + 1)
        begin = found.at[first:last] - found.at[first]
        own = found.data[found.at[first]:found.at[last]].astype(np.uint64) + np.uint64(1)
        own *= powers[np.arange(len(own)) - np.repeat(begin, lengths[first:last])]
        sums[first:last] = np.add.reduceat(own, begin)
        first = last
    return np.maximum(mix(mix(sums + lengths.astype(np.uint64)) + lang), np.uint64(1))


def _pieces(batch: pa.RecordBatch, block: int, seed: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Blocks of a batch (lang, text): words, their hashes, how many follow in their piece, all languages, that of each word."""
    langs = pc.fill_null(batch.column(0).cast(pa.string()), "und").dictionary_encode()
    names, of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
    marks = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in names.to_pylist()], np.uint64)
    data, offsets = text_buffers(batch.column(1))
    for first, last in blocks(offsets, block):
        found = words(data, offsets[first:last + 1], _SEPARATORS)
        doc = np.repeat(np.arange(last - first), np.diff(found.of))
        lang = of[first:last][doc]
        broken = np.searchsorted(np.flatnonzero(_IS_BREAK[data[offsets[first]:offsets[last]]]), found.start)
        joined = (doc[1:] == doc[:-1]) & (broken[1:] == broken[:-1])
        ends = np.append(np.flatnonzero(~joined), found.n - 1)
        follow = ends[np.searchsorted(ends, np.arange(found.n))] - np.arange(found.n) if found.n else np.zeros(0, np.int64)
        yield found, word_ids(found, marks[lang] if found.n else np.zeros(0, np.uint64), seed), follow, names, lang


def _suffixes(ids: np.ndarray, follow: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """(longest, n): the words from each place ``at`` on, 0 behind the end of the piece."""
    out = np.zeros((longest, len(at)), ids.dtype)
    for k in range(longest):
        inside = follow[at] >= k
        out[k, inside] = ids[at[inside] + k]
    return out


def _packed(own: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Suffixes ``own[places]`` as byte strings that sort like them."""
    return own.astype(">u8")[np.ascontiguousarray(places.T)].view(f"S{8 * len(places)}").ravel()


def _bytes(packed: np.ndarray) -> pa.Array:
    size = packed.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(size), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())


def word_counts(docs: DataFrame, seed: int, longest: int, block: int, step: int) -> DataFrame:
    """Words of every block with their counts, and every ``step``-th suffix."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found, ids, follow, names, lang in _pieces(batch, block, seed):
                own, first, n = np.unique(ids, return_index=True, return_counts=True)
                if not len(own):
                    continue
                lengths = found.lengths()[first]
                at = np.concatenate([[0], np.cumsum(lengths)])
                taken = np.arange(at[-1]) + np.repeat(found.at[:-1][first] - at[:-1], lengths)
                text = pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(at.tobytes()),
                                                                           pa.py_buffer(found.data[taken].tobytes())])
                yield pa.record_batch([names.take(pa.array(lang[first])), text.cast(pa.string()), pa.array(own.view(np.int64)),
                                       pa.array(n.astype(np.int64)), pa.nulls(len(own), pa.binary())], columns)
                noted = np.arange(int(ids[0] % np.uint64(step)), len(ids), step)
                suffixes = _bytes(_packed(*np.unique(_suffixes(ids, follow, noted, longest), return_inverse=True)))
                none = [pa.nulls(len(noted), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
                yield pa.record_batch([*none, suffixes], columns)

    columns = ["lang", "word", "id", "n", "suffix"]
    return docs.mapInArrow(count, "lang string, word string, id bigint, n bigint, suffix binary")


def borders(noted: DataFrame, step: int, route: int, most: int) -> np.ndarray:
    """Ascending byte strings of suffixes that cut all of them into routes."""
    every = max(route // step, -(-noted.count() // most), 1)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            kept = np.arange(-(place + 1) % every, batch.num_rows, every)
            place += batch.num_rows
            yield batch.take(pa.array(kept))

    rows = noted.orderBy("suffix").mapInArrow(thin, "suffix binary").distinct().toArrow()
    size = len(rows.column(0)[0].as_py()) if rows.num_rows else 8
    return np.sort(np.array(rows.column(0).to_pylist(), dtype=f"S{size}"))


def _equal_added(ids: np.ndarray, follow: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a block behind a 0, its distinct suffixes of two and more words in order as places there, and how often
    each occurs."""
    own, dense = np.unique(ids, return_inverse=True)
    bits = max(int(len(own)).bit_length(), 1)
    keys, per = [], 64 // bits  # words a 64-bit sort key holds
    suffixes = _suffixes((dense + 1).astype(np.uint32), follow, np.flatnonzero(follow), longest)
    for first in range(0, longest, per):
        key = suffixes[first].astype(np.uint64)
        for row in suffixes[first + 1:first + per]:
            key <<= np.uint64(bits)
            key |= row
        keys.append(key)
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for key in keys:
        key = key[order]
        changed[1:] |= key[1:] != key[:-1]
    heads = np.flatnonzero(changed)
    return np.append(np.uint64(0), own), suffixes[:, order[heads]], np.diff(np.append(heads, len(order)))


def _encoded(own: np.ndarray, suffixes: np.ndarray, n: np.ndarray) -> bytes:
    """Suffixes with their numbers, compressed: the words they use, once each, and their places among these."""
    used = np.zeros(len(own), bool)
    used[suffixes.ravel()] = True
    local = np.cumsum(used) - 1
    kept = own[used]
    places = local[suffixes].astype(np.uint16 if len(kept) <= 1 << 16 else np.uint32)
    raw = np.array([len(kept), len(n), places.itemsize], np.int64).tobytes() + kept.tobytes() + n.astype(np.int64).tobytes() + places.tobytes()
    return len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "big"), codec="zstd", asbytes=True)
    words_, n, size = np.frombuffer(raw, np.int64, 3).tolist()
    own = np.frombuffer(raw, np.uint64, words_, 24)
    count = np.frombuffer(raw, np.int64, n, 24 + 8 * words_)
    places = np.frombuffer(raw, np.uint16 if size == 2 else np.uint32, -1, 24 + 8 * (words_ + n))
    return own[places.reshape(-1, n)], count


def routed(docs: DataFrame, cuts: np.ndarray, seed: int, longest: int, block: int) -> DataFrame:
    """(route, part): the sorted, added-up suffixes of every block, cut at the borders."""
    cuts = docs.sparkSession.sparkContext.broadcast(cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, follow, _, _ in _pieces(batch, block, seed):
                own, suffixes, n = _equal_added(ids, follow, longest)
                at = np.concatenate([[0], np.searchsorted(_packed(own, suffixes), cuts.value), [len(n)]])
                filled = np.flatnonzero(np.diff(at))
                parts = [_encoded(own, suffixes[:, at[r]:at[r + 1]], n[at[r]:at[r + 1]]) for r in filled.tolist()]
                yield pa.record_batch([pa.array(filled.astype(np.int64)), pa.array(parts, pa.binary())], ["route", "part"])

    return docs.mapInArrow(cut, "route bigint, part binary")


def quicksort(suffixes: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, counts), in any order, of all phrases that begin at least ``least`` suffixes.

    ``suffixes`` has a row per word position and a column per suffix that occurs ``n`` times; phrases are such columns, 0 behind
    their last word.
    """
    longest, stack = len(suffixes), [(np.arange(len(n)), 0)] if len(n) else []
    while stack:
        at, depth = stack.pop()
        if len(at) <= SMALL:
            yield from _finished(suffixes, n, at, depth, least)
            continue
        key = suffixes[depth, at]
        some = np.sort(key[:: max(len(key) // 31, 1)])
        pivot = some[len(some) // 2]
        equal = key == pivot
        for other in (at[key < pivot], at[key > pivot]):
            if n[other].sum() >= least:
                stack.append((other, depth))
        same = at[equal]
        count = n[same].sum()
        if pivot and count >= least:
            phrase = np.zeros((longest, 1), np.uint64)
            phrase[:depth + 1, 0] = suffixes[:depth + 1, same[0]]
            yield phrase, np.array([count])
            if depth + 1 < longest:
                stack.append((same, depth + 1))


def _finished(suffixes: np.ndarray, n: np.ndarray, at: np.ndarray, depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for a short partition: one sort a word position, all its parts at once, the rare ones abandoned."""
    part = np.zeros(len(at), np.int64)
    for d in range(depth, len(suffixes)):
        key = suffixes[d, at]
        order = np.lexsort([key, part])
        at, key, part = at[order], key[order], part[order]
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        count = np.add.reduceat(n[at], heads)
        kept = (count >= least) & (key[heads] != 0)
        if not kept.any():
            return
        phrases = np.zeros((len(suffixes), int(kept.sum())), np.uint64)
        phrases[:d + 1] = suffixes[:d + 1, at[heads[kept]]]
        yield phrases, count[kept]
        sizes = np.diff(np.append(heads, len(at)))
        part = np.repeat(np.arange(len(heads)), sizes)
        inside = np.repeat(kept, sizes)
        at, part = at[inside], part[inside]


def _route_counts(suffixes: np.ndarray, n: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frequent phrases of one route; those that begin a border (a column of ``ends``) with what this route holds of them."""
    longest = len(suffixes)
    open_ = {tuple(b[:d].tolist()) for b in ends.T for d in range(1, longest + 1) if b[d - 1]}
    shared = np.zeros((longest, len(open_)), np.uint64)
    for i, phrase in enumerate(sorted(open_)):
        shared[:len(phrase), i] = phrase
    if len(open_):
        held = [n[np.all(suffixes[:len(p)] == np.array(p, np.uint64)[:, None], axis=0)].sum() for p in sorted(open_)]
        yield shared, np.array(held)
    marks = set(map(bytes, shared.T))
    for phrases, count in quicksort(suffixes, n, least):
        own = np.array([bytes(p) not in marks for p in phrases.T])
        yield phrases[:, own], count[own]


def frequent(parts: DataFrame, cuts: np.ndarray, longest: int, least: int) -> DataFrame:
    """(phrase, n): hashes of the words of every phrase of 2 to ``longest`` words that occurs at least ``least`` times."""
    cuts = parts.sparkSession.sparkContext.broadcast(cuts)

    def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        phrases = np.concatenate([p for p, _ in found], axis=1)
        count = np.concatenate([c for _, c in found]).astype(np.int64)
        held = count > 0
        phrases, count = phrases[:, held], count[held]
        size = 8 * (phrases != 0).sum(axis=0)
        inside = (np.arange(8 * longest) < size[:, None])
        data = np.ascontiguousarray(phrases.T).astype(">u8").view(np.uint8).reshape(len(count), 8 * longest)[inside]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
        return pa.record_batch([own, pa.array(count)], ["phrase", "n"])

    def counted(route: int, blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_decoded(b) for b in blobs]
        suffixes, n = np.concatenate([p for p, _ in parts], axis=1), np.concatenate([c for _, c in parts])
        size = 8 * longest
        ends = b"".join(c.ljust(size, b"\0") for c in cuts.value[max(route - 1, 0):route + 1].tolist())
        ends = np.frombuffer(ends, ">u8").reshape(-1, longest).T.astype(np.uint64)
        return rows(list(_route_counts(suffixes, n, ends, least)) or [(suffixes[:, :0], n[:0])])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, blobs = -1, []
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != route and blobs:
                    yield counted(route, blobs)
                    blobs = []
                route = own
                blobs.append(blob.as_py())
        if blobs:
            yield counted(route, blobs)

    found = parts.repartition("route").sortWithinPartitions("route").mapInArrow(sort, "phrase binary, n bigint")
    many = found.filter(F.octet_length("phrase") > 8)
    return many.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT,
    block: int = BLOCK, step: int = STEP, route: int = ROUTE, most_routes: int = MOST_ROUTES,
) -> tuple[DataFrame, DataFrame]:
    """(phrase, n) of all frequent phrases, single words too, and the vocabulary (lang, word, id, n) that tells their words."""
    rows = docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    seed, clash = 0, True
    while clash:
        noted = stored(word_counts(rows, seed, longest, block, step), "word-counts")
        vocabulary = stored(noted.filter("suffix is null").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "vocabulary")
        clash = not vocabulary.groupBy("id").count().filter("count > 1").isEmpty()
        seed += 1
    cuts = borders(noted.filter("suffix is not null").select("suffix"), step, route, most_routes)
    single = vocabulary.filter(F.col("n") >= least)
    parts = routed(rows, cuts, seed - 1, longest, block)
    phrases = frequent(parts, cuts, longest, least).unionByName(single.select(_phrase("id").alias("phrase"), "n"))
    return stored(phrases, "phrases"), vocabulary


def _phrase(id_: str) -> Column:
    """A hash as the phrase of that word alone."""
    return F.expr(f"to_binary(lpad(hex({id_}), 16, '0'), 'hex')")


def _candidates(phrases: DataFrame) -> DataFrame:
    """(phrase, a, words) of phrases of two and more words that no longer one contains as often.

    What lies in a longer phrase lies in one a single word longer too, and that one occurs at least as often.
    """
    held = phrases.withColumn("words", (F.octet_length("phrase") / 8).cast("int"))
    longer = held.filter("words > 2").select(F.explode(F.array(
        F.expr("substring(phrase, 1, 8 * words - 8)"), F.expr("substring(phrase, 9)"))).alias("phrase"), "n")
    most = longer.groupBy("phrase").agg(F.max("n").alias("longer"))
    kept = F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED * F.col("n"))
    return held.filter("words > 1").join(most, "phrase", "left").filter(kept).select("phrase", F.col("n").alias("a"), "words")


def _cut(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """(phrase, k, l, r): the counts of both parts at every cut."""
    cuts = stored(candidates.select("phrase", F.explode(F.expr("sequence(1, words - 1)")).alias("k")), "cuts")
    counted = phrases.withColumnRenamed("phrase", "part")
    first = meet(cuts.withColumn("part", F.expr("substring(phrase, 1, 8 * k)")), counted.withColumnRenamed("n", "l"), "part")
    rest = stored(first.withColumn("part", F.expr("substring(phrase, 8 * k + 1)")), "first-parts")
    return meet(rest, counted.withColumnRenamed("n", "r"), "part").drop("part")


def _spelled(candidates: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """(phrase, lang, spelled, n): the words of each candidate, and how many words its language has."""
    totals = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    known = stored(vocabulary.filter(F.col("n") >= least).join(totals, "lang").select(
        _phrase("id").alias("part"), "lang", "word", "total"), "known-words")
    each = stored(candidates.select("phrase", F.explode(F.expr("sequence(0, words - 1)")).alias("k")).withColumn(
        "part", F.expr("substring(phrase, 8 * k + 1, 8)")), "phrase-words")
    words_ = meet(each, known, "part").groupBy("phrase").agg(
        F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"), F.any_value("lang").alias("lang"), F.max("total").alias("n"))
    return words_.select("phrase", "lang", F.array_join(F.col("w.word"), " ").alias("spelled"), "n")


def _score() -> Column:
    """floor(SCALE * a * n / (l * r)) of whole numbers: products of two counts need more than 64 bits."""
    wide = [f"cast({c} AS decimal(18, 0))" for c in "anlr"]
    return F.expr(f"({SCALE} * ({wide[0]} * {wide[1]})) div ({wide[2]} * {wide[3]})")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every language: first of each of 64 parts of it, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    few = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return few.filter(F.col("rank") <= top).withColumn("rank", first).filter(F.col("rank") <= top).drop("part")


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, **sizes: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of every language."""
    phrases, vocabulary = counts(docs, text, lang, longest, least, **sizes)
    candidates = stored(_candidates(phrases), "candidates")
    whole = candidates.join(_spelled(candidates, vocabulary, least), "phrase")
    lowest = _cut(candidates, phrases).join(whole, "phrase").withColumn("score", _score()).groupBy("phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n", "lang", "spelled")).alias("cut")).select("cut.*")
    return _ranked(lowest.drop("k").withColumnRenamed("spelled", "phrase"), top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
