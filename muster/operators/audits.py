"""Key audits whose clean rows stay where they are: only suspects are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators import joins
from muster.session import stored

#: Keys a bitmap covers, as 4 KB.
CHUNK_BITS = 15
#: Bitmaps that may be broadcast (64 MB).
MOST_CHUNKS = 1 << 14
#: Slots of the filter of repeated keys, as 512 KB.
SLOTS = 1 << 22


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """Foreign keys without a parent and how many rows carry each, for whole-number keys.

    The parent's keys become bitmaps, one for each 32768 neighbouring numbers. If these are few enough to be broadcast (numbered keys
    are: 500 million take 64 MB), each child row is checked where it is and only rows without a parent are grouped. Keys that lie so
    far apart that their bitmaps are more go the other way, by distinct keys and an anti join.
    """
    def chunk(name: str) -> Column:
        return F.shiftright(F.col(name).cast("bigint"), CHUNK_BITS)

    place = F.expr(f"CAST(CAST(`{parent_key}` AS BIGINT) & {(1 << CHUNK_BITS) - 1} AS BIGINT)")
    own = parent.filter(F.col(parent_key).isNotNull())
    if own.select(chunk(parent_key).alias("chunk")).distinct().limit(most_chunks + 1).count() > most_chunks:
        return joins.orphans(child, key, parent, parent_key)
    bitmaps = stored(own.groupBy(chunk(parent_key).alias("chunk")).agg(F.bitmap_construct_agg(place).alias("bits")), "key-bitmaps")
    rows = child.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), chunk(key).alias("chunk"), F.expr(f"CAST(CAST(`{key}` AS BIGINT) & {(1 << CHUNK_BITS) - 1} AS INT)").alias("at"))
    met = rows.join(F.broadcast(bitmaps), "chunk", "left")
    byte = "CAST(conv(hex(substring(bits, shiftright(at, 3) + 1, 1)), 16, 10) AS INT)"
    suspects = met.filter(F.expr(f"bits IS NULL OR (shiftright({byte}, at & 7) & 1) = 0"))
    return suspects.groupBy("key").agg(F.count("*").alias("rows"))


def duplicate_keys(df: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """Values that break a uniqueness rule, and how many rows have each.

    A first pass counts keys per slot of a hash, which is ``slots`` numbers at most whatever the table; rows whose slot was hit once
    are unique and leave at the scan of the second pass. The filter tells the more apart the more slots there are for a key.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).cast("string").alias("key")).withColumn(
        "slot", F.xxhash64("key").bitwiseAND(F.lit(slots - 1).cast("bigint")))
    hit = named.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    words = hit.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    filled = spark.range(-(-slots // 64)).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    filter_ = stored(filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("f")), "key-slots")
    marked = named.withColumn("f", filter_.select("f").scalar())
    suspects = marked.filter(F.expr("(shiftrightunsigned(f[CAST(shiftright(slot, 6) AS INT)], CAST(slot & 63 AS INT)) & 1L) = 1"))
    return suspects.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
