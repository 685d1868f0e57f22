"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and ``limit``. Among all rates whose words meet each source's target, those nearest to
1 in relative entropy are exponentials of the document's size, cut off at the limit: ``least(limit, exp(lambda * a))`` with
``a`` the size over its source's mean size and one dual variable ``lambda`` a source. The dual is convex, its slope is monotone
in lambda; Newton steps inside a closing bracket find it. Documents of a source and size have the same rate, so one shuffle
reduces the corpus to counts by source and size, and each iteration is one aggregate over those counts.

Rates become whole copies without drifting from the target: per source, from the largest size to the smallest, the copies of a
size are rounded after adding what the larger sizes left over, so that at the end less than a smallest document is missing.
Within a size, copies are dealt by a hash of the id; a hash bucket is ranked by itself, so that a size held by a third of all
rows is spread over ``BUCKETS`` groups.

Sources are ordered by code point, null is a source and comes last. Null and word-less texts have size 0 and take nothing.
Repeated ids are separate documents, equal rows are interchangeable. Without words all targets are 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.columns import mark, spare
from muster.session import stored

WEIGHTS, LIMIT = (5.0, 2.0, 1.0), 3.0
BUCKETS = 4096
#: Words a source may miss its target by after the Newton iterations, relative to it.
TOLERANCE = 1e-7

_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) with ``number`` (from 0, by code point) and ``target``.

    The total is shared by weight and no target is above ``limit`` times its source's size: the sources that stop there are those
    with the smallest sizes for their weight, the others share the rest by weight. One row a source goes through the windows.
    """
    numbered = sources.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weighed = numbered.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("number", F.lit(len(weights))) + 1)
    ).withColumn("stop", limit * F.col("source_size"))
    order = [F.col("stop") / F.col("weight"), F.col("number")]
    until = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reached = F.sum("stop").over(until) + order[0] * F.coalesce(F.sum("weight").over(after), F.lit(0.0))
    level = weighed.withColumn("total", F.sum("source_size").over(whole)).withColumn("reached", reached)
    level = level.withColumn("stopped", F.col("reached") <= F.col("total"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(whole), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole)
    target = F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("weight") * rest / open_)
    return level.select("source", "source_size", "number", F.least(target, "stop").alias("target"))


def _rate(limit: float) -> Column:
    """The tilted rate of a size; cut off in the exponent, so that nothing overflows."""
    return F.exp(F.least(F.lit(math.log(limit)), F.col("dual") * F.col("size") / F.col("mean")))


def solve(counts: DataFrame, sources: DataFrame, limit: float = LIMIT, tolerance: float = TOLERANCE) -> DataFrame:
    """(number, mean, dual) of each source with words.

    ``counts`` has (number, size, n), sizes above 0; ``sources`` has (number, source_size, target).
    """
    own = counts.groupBy("number").agg(
        F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = own.join(sources.select("number", "target"), "number").select(
        "number", "target", (F.col("words") / F.col("docs")).alias("mean"), F.col("words").cast("double").alias("words"),
        (F.col("least") * F.col("docs") / F.col("words")).alias("first"),
    ).withColumns({
        "full": F.col("target") >= limit * F.col("words") * (1 - tolerance),
        "low": F.when(F.col("target") < F.col("words"), F.log(F.col("target") / F.col("words")) / F.col("first")).otherwise(0.0),
        "high": F.when(F.col("target") < F.col("words"), 0.0).otherwise(math.log(limit) / F.col("first")),
    })
    state = stored(state.select(
        "number", "target", "mean", "low", "high",
        F.when(F.col("full"), F.col("high")).otherwise(0.0).alias("dual"), F.col("full").alias("done")), "dual")
    while state.filter("not done").limit(1).count():
        words = F.col("n") * F.col("size") * _rate(limit)
        inner = F.col("dual") * F.col("size") / F.col("mean") < math.log(limit)
        slope = F.when(inner, words * F.col("size") / F.col("mean")).otherwise(0.0)
        moments = counts.join(state.filter("not done").select("number", "mean", "dual"), "number").groupBy("number").agg(
            F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        short = F.col("words") < F.col("target")
        low, high = F.when(short, F.col("dual")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("dual"))
        step = F.col("dual") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))
        middle = (F.col("_low") + F.col("_high")) / 2
        met = F.abs(F.col("words") - F.col("target")) <= tolerance * F.col("target")
        state = stored(state.join(moments, "number", "left").withColumns({"_low": low, "_high": high, "_step": step}).select(
            "number", "target", "mean",
            F.when(F.col("done"), F.col("low")).otherwise(F.col("_low")).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(F.col("_high")).alias("high"),
            F.when(F.col("done") | met, F.col("dual"))
            .when((F.col("_step") > F.col("_low")) & (F.col("_step") < F.col("_high")), F.col("_step")).otherwise(middle).alias("dual"),
            (F.col("done") | met | (middle <= F.col("_low")) | (middle >= F.col("_high"))).alias("done"),
        ), "dual")
    return state.select("number", "mean", "dual")


def _whole_copies(most: int):
    def of_source(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        copies, left = [], 0.0
        for size, n, rate in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist(), strict=True):
            wanted = n * rate + left / size
            taken = min(max(math.floor(wanted + 0.5), 0), most * n)
            left = (wanted - taken) * size
            copies.append(taken)
        return sizes.assign(copies=copies)

    return of_source


def mix(
    documents: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, limit: float = LIMIT, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, and the columns named in ``keep``."""
    rows = stored(documents.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), *keep), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(by_source, weights, limit), "targets")
    numbers = sources.select(F.col("source").alias("_source"), "number")
    numbered = rows.join(numbers, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("deal")), F.lit(BUCKETS)))

    counts = stored(numbered.filter("size > 0").groupBy("number", "size").agg(F.count("*").alias("n")), "counts")
    rated = counts.join(solve(counts, sources, limit), "number").withColumn("rate", _rate(limit)).select("number", "size", "n", "rate")
    whole = rated.groupBy("number").applyInPandas(
        _whole_copies(math.floor(limit)), "number int, size bigint, n bigint, rate double, copies bigint")
    sizes = stored(whole, "copies")

    earlier = Window.partitionBy("number", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = numbered.filter("size > 0").groupBy("number", "size", "bucket").agg(F.count("*").alias("own"))
    shares = filled.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(
        sizes, ["number", "size"]).select("number", "size", "bucket", "before", "rate", "n", "copies")
    within = Window.partitionBy("number", "size", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    placed = numbered.join(shares, ["number", "size", "bucket"], "left").withColumn(
        "place", F.col("before") + F.row_number().over(within) - 1)
    copies = F.when(F.col("n").isNull(), 0).otherwise(
        F.floor(F.col("copies") / F.col("n")) + F.when(F.col("place") < F.col("copies") % F.col("n"), 1).otherwise(0))
    return placed.join(sources.select("number", "source_size", "target"), "number").select(
        "doc_id", "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate"),
        copies.cast("bigint").alias("copies"), *keep)


def mixed(documents: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with their ``copies`` (a column of that name is replaced); those of equal rows are added up."""
    documents = documents.drop("copies")
    name = spare(documents, "own_mark")
    own = documents.withColumn(name, mark(documents))
    copies = mix(own, id=id, keep=[name], **options)
    copies = copies.groupBy("doc_id", name).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    copies = copies.select(F.struct(F.col("doc_id").alias("id"), F.col(name).alias("mark"), "copies").alias("taken"))
    taken = copies["taken"]
    found = own.join(copies, own[id].eqNullSafe(taken["id"]) & (own[name] == taken["mark"]))
    kept = found.select(*[own[c] for c in own.columns], taken["copies"].alias("copies"))
    return kept.dropDuplicates([id, name]).drop(name)
