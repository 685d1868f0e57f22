"""Lines that many documents share, dropped from all of them.

Texts are split at ``\\n``. A line's key is the line without white space at its ends, A-Z lower-cased. A first pass explodes
each document's distinct keys, hashes them and counts documents per hash: partial counts leave the tasks, never lines. A
second pass explodes the places of all lines, keeps those whose hash reached the threshold, gathers them per document, and
puts the lines between them together again by position. Built-in functions only.

No hash is a bottleneck: the hashes that stand for a ``SHARE``-th or more of all common occurrences are at most ``SHARE``, so
they are broadcast; all others meet their lines in a shuffle that carries 32 characters of hash, the document's mark and a
position for each line. Text moves once, to meet the places to drop (not at all where Spark measures those to be few). A
document's lines fit in a task, like its text.

Rows are documents: repeated rows count once each, whatever their ids, and get equal results. A null text is like an empty
one: a single empty line. Keys shorter than ``min_chars`` never count. Ties don't exist: a threshold decides. A text all of
whose lines go becomes empty. Very long texts and lines are hashed whole; work is linear in lines. Without rows the result is
empty. Columns of any name pass through; one named like ``out`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.session import stored

MIN_DOCS, MIN_CHARS = 10, 1
#: A hash with this part of all common occurrences is broadcast; there are at most so many.
SHARE = 1000
#: White space that ends of lines are rid of: \x20 and \x09 to \x0D.
BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """What tells lines apart. ``lower`` does the same as ``translate`` on ASCII, and faster."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hash(line: Column, min_chars: int) -> Column:
    own = key(line)
    return F.when(F.char_length(own) >= min_chars, F.md5(own))


def _marks(identity: Column, text: Column) -> list[Column]:
    """128 bits that tell documents apart; equal ones have equal lines, so they may share a mark."""
    parts = [identity.isNull(), identity.cast("string"), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(*parts).alias("m1"), F.xxhash64(F.lit("second"), *parts).alias("m2")]


def common_lines(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(hash, n) of the hashes found in at least ``min_docs`` of the rows whose ``hashes`` are given."""
    each = keyed.select(F.explode(F.array_distinct("hashes")).alias("hash")).filter("hash is not null")
    return each.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs)


def places(keyed: DataFrame, common: DataFrame) -> DataFrame:
    """(m1, m2, at): ascending places, from 0, of the common lines of every document that has some."""
    total = common.agg(F.sum("n"))
    held = common.withColumn("hot", F.col("n") * SHARE >= total.scalar())
    hot = F.broadcast(held.filter("hot").select("hash"))
    each = keyed.select("m1", "m2", F.posexplode("hashes").alias("place", "hash")).filter("hash is not null")
    near = each.join(hot, "hash", "left_semi")
    far = each.join(hot, "hash", "left_anti").join(held.filter("not hot").select("hash"), "hash", "left_semi")
    return near.union(far).groupBy("m1", "m2").agg(F.array_sort(F.collect_set("place")).alias("at"))


def _between(of: str, at: str) -> Column:
    """The lines ``of`` but for those ``at`` ascending places: the runs between two of them, one after the other."""
    return F.expr(f"""
        flatten(transform(sequence(0, size({at})), i -> slice({of},
            if(i = 0, 0, {at}[i - 1] + 1) + 1,
            if(i = size({at}), size({of}), {at}[i]) - if(i = 0, 0, {at}[i - 1] + 1))))""")


def dedup(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", out: str = "lines",
    min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with ``out``: n_lines, n_dropped and the text without lines that at least ``min_docs`` documents hold."""
    own = docs[text]
    hashes = F.transform(lines(own), lambda line: _hash(line, min_chars)).alias("hashes")
    keyed = stored(docs.select(*_marks(docs[identity], own), hashes), "line-hashes")
    drop = places(keyed, stored(common_lines(keyed, min_docs), "common-lines"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_marks(docs[identity], own))
    met = rows.join(drop, ["m1", "m2"], "left").select("row", F.coalesce("at", F.expr("array()")).cast("array<int>").alias("at"))
    # a one-row generator: the lines are split once and not again in each of the uses below
    split = met.select("row", "at", F.inline(F.array(F.struct(lines(F.col("row")[text]).alias("of")))))
    result = F.struct(
        F.size("of").cast("bigint").alias("n_lines"), F.size("at").cast("bigint").alias("n_dropped"),
        F.array_join(_between("of", "at"), "\n").alias("text"),
    )
    return split.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], result.alias(out))
