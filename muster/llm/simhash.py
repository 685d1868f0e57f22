"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints with at most ``d`` differing bits differ in at most d bytes, so
they share at least 8 - d positional bytes: the guaranteed minimum. The index lists fingerprints by positional bytes, the
bytes shared by a pair are tallied, pairs below the minimum are dropped, and the bit distance of the others is verified.

A list of one positional byte holds a 256th of all fingerprints and would make a square of that in pairs. So each list is
keyed by several positions at once: the eight positions are cut into d + 2 runs, a pair within reach shares at least two
whole runs, and there is a list for each two runs. Lists of up to ``SHORT`` fingerprints are paired. The members of a longer
list (large groups of near copies) are listed again by every choice of 8 - d positions; a pair within reach shares one such
choice, so the lists lose no link. Members of such a list share the guaranteed minimum by their place in it, and only the
bit distance is open: up to ``SHORT`` of them are paired, more meet at values one bit away. Two fingerprints are within 2 bits
exactly if a value one bit away from both (or one of them) exists, so each member goes to its 65 such values, and the members
of a value are linked to its smallest. On all three ways the shared bytes are tallied, pairs below the minimum dropped and
the distance verified; none loses a link or grows with the square of a group. Copies fall together before all that.

Null and word-less texts have fingerprint 0 and are linked like others. Rows are judged one by one: repeated ids keep
their rows. A null id is never the smallest of a component unless there is no other. Without rows the result is empty.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.columns import mark, spare
from muster.llm.graph import components
from muster.llm.words import SPACED_LOWER, blocks, text_buffers, words
from muster.session import stored

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Up to so many fingerprints of an index list are paired with each other; longer lists are listed by more positions.
SHORT = 64


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """Unsigned fingerprints of a block of documents."""
    found = words(data, offsets, SPACED_LOWER)
    out = np.zeros(len(offsets) - 1, np.uint64)
    n_words = np.diff(found.of)
    counts = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    filled = np.flatnonzero(counts)
    if not len(filled):
        return out
    text, begin, end = found.spaced()
    starts = np.cumsum(counts) - counts
    first = np.arange(counts.sum()) + np.repeat(found.of[:-1] - starts, counts)
    last = first + np.repeat(np.minimum(n_words, shingle) - 1, counts)
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(text[a:z], seed) for a, z in zip(begin[first].tolist(), end[last].tolist(), strict=True)], np.uint64
    )
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    tally = np.add.reduceat(bits, starts[filled], axis=0, dtype=np.int32)
    chosen = tally * 2 > counts[filled][:, None]
    out[filled] = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The 64-bit fingerprint of a text as a signed long."""
    @F.arrow_udf("bigint")
    def own(texts: pa.Array) -> pa.Array:
        data, offsets = text_buffers(texts)
        parts = [fingerprints_of(data, offsets[a:z + 1], shingle, seed) for a, z in blocks(offsets)]
        return pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))

    return own.asNondeterministic()(text)


def _runs(max_bits: int) -> list[int]:
    """Bit masks of the runs of positions."""
    cuts = np.linspace(0, 8, max_bits + 3).round().astype(int)
    return [sum(0xFF << (8 * p) for p in range(a, z)) for a, z in itertools.pairwise(cuts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def shared_bytes(a: Column, b: Column) -> Column:
    """In how many of the eight positions two fingerprints have the same byte."""
    other = a.bitwiseXOR(b)
    return sum(F.when(other.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0, 1).otherwise(0) for p in range(8))


def _listed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(list, bytes, fp, n): the index lists of two fingerprints or more, a list for each mask, with their sizes."""
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes"))
                      for k, m in enumerate(masks)])
    postings = prints.select("fp", F.inline(lists))
    sizes = postings.groupBy("list", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    return stored(postings.join(sizes, ["list", "bytes"]), "postings")


def _paired(listed: DataFrame) -> DataFrame:
    """All pairs (u, v) of each list."""
    return (
        listed.groupBy("list", "bytes").agg(F.array_sort(F.collect_list("fp")).alias("own"))
        .select("own", F.posexplode("own").alias("at", "u"))
        .select("u", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("v"))
    )


def _met(prints: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (u, v) that connect the fingerprints within ``max_bits`` of each other, by values one bit away."""
    flips = [F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]
    if max_bits < 2:  # values that are themselves one bit apart: a member meets its neighbours' own values
        met = prints.select(F.col("fp").alias("u"), F.explode(F.array(*flips) if max_bits else F.array("fp")).alias("v"))
        return met.join(prints.select(F.col("fp").alias("v")), "v").select("u", "v").filter("u <> v")
    met = prints.select("fp", F.explode(F.array("fp", *flips)).alias("value"))
    least = met.groupBy("value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return met.join(least, "value").filter("fp <> v").select(F.col("fp").alias("u"), "v")


def links(prints: DataFrame, max_bits: int = MAX_BITS, short: int = SHORT) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within ``max_bits`` (at most 2) of each other."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    few, many = F.col("n") <= short, F.col("n") > short
    by_runs = _listed(prints, [a | b for a, b in itertools.combinations(_runs(max_bits), 2)])
    crowded = by_runs.filter(many).select("fp").distinct()
    choices = [sum(0xFF << (8 * p) for p in own) for own in itertools.combinations(range(8), 8 - max_bits)]
    by_choice = _listed(crowded, choices)
    dense = by_choice.filter(many).select("fp").distinct()
    met = _paired(by_runs.filter(few)).union(_paired(by_choice.filter(few))).union(_met(dense, max_bits))
    return (
        met.filter(shared_bytes(F.col("u"), F.col("v")) >= 8 - max_bits)
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits).distinct()
    )


def grouped(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``root``, the smallest fingerprint reachable, and ``component_id``, the smallest id."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(prints.select("fp"), max_bits))
    placed = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    own = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(placed.select("fp", "root").join(own, "root"), "fp")


def near_duplicates(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, fp, root and component_id."""
    rows = documents.select(F.col(id).alias("doc_id"), fingerprint(F.col(text), shingle, seed).alias("fp"))
    return grouped(stored(rows, "fingerprints"), max_bits).select("doc_id", "fp", "root", "component_id")


def keep_one(documents: DataFrame, *, id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``documents`` with one row of each group: that of the smallest id (null last); of several such rows one."""
    own = mark(documents)
    rows = stored(documents.select(F.col(id).alias("doc_id"), fingerprint(F.col(text)).alias("fp"), own.alias("mark")), "fingerprints")
    groups = grouped(rows, max_bits).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("root").agg(F.min_by("mark", F.struct("doc_id", "mark")).alias("kept_mark"), F.min("doc_id").alias("kept_id")).drop("root")
    name = spare(documents, "own_mark")
    found = documents.withColumn(name, own)
    found = found.join(kept, (found[name] == kept["kept_mark"]) & found[id].eqNullSafe(kept["kept_id"]), "left_semi")
    return found.dropDuplicates([name, id]).drop(name)
