"""URL filters: rules on hosts and paths, and trust spread over the links between hosts where no rule decides.

Hosts whose pages a rule allows are trusted seeds, hosts whose pages a rule blocks are distrusted seeds. Personalised PageRank
carries trust along links and distrust against them; a host is blocked if its distrust is above ``RATIO`` times its trust. Edges
come from absolute links and from the host tree, where a host and its parent domain link each other. Addresses have no place in
the tree, and neither have parents that only register names for others (a top level, or ``co.uk`` and the like, ``PUBLIC``): owners
below them have nothing in common. A port belongs to its host: the host with it and the host without it link each other.

Pages are reduced to hosts and host edges before anything iterates; all of it is joins and sums in Spark. Ranks run until every
single one is settled relative to itself, so however far a host is from a seed and however many pages share the seeds, its
verdict is that of the settled ranks. What arrives at a host without onward edges goes back to the seeds: that multiplies all
settled ranks of a kind by one factor, so they are divided by their sum once, at the end.

A null url or one without ``://`` has an empty host and path. No rule fits it; its host is in no graph and is allowed, as is every
host out of reach of all seeds. A null html has no links. Pages are judged row by row, whatever their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.session import steady, stored

#: Fixed values: (verdict, host and path).
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
DAMPING, RATIO = 0.85, 1.0
#: Ranks are settled when ``ROUND`` iterations change none of them by more than this part of itself.
TOLERANCE, ROUND = 1e-7, 5
#: Steps (edges in one direction) for each task of an iteration.
STEPS = 50_000
#: Distrust over trust is compared to so many decimals, so that the order of sums does not decide a tie.
RATIO_DECIMALS = 6
#: Hosts that are addresses, and names of two labels under which owners register names of their own.
ADDRESS, PUBLIC = r"^[0-9.]*\z|[\[\]:]", r"^(ac|co|com|edu|go|gob|gov|ne|net|or|org)[.][a-z][a-z]\z"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``."""
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; of equally long ones a blocking rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def edges_of(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links that pages of one make to the other, and the host tree."""
    links = F.filter(F.regexp_extract_all("html", F.lit(r"""(?i)\shref\s*=\s*["']\s*((?:https?:)?//[^"'\s>]*)"""), 1),
                     lambda x: x.isNotNull())
    absolute = F.transform(links, lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x)))
    linked = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(absolute).alias("dst")).filter("dst <> '' and dst <> src")
    linked = linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").filter("host <> ''").distinct().union(linked.select("dst")).distinct()
    bare = F.regexp_replace("host", r":[0-9]*\z", "")
    ported = hosts.filter(bare != F.col("host")).select(F.col("host").alias("child"), bare.alias("parent")).filter("parent <> ''")
    named = hosts.select(bare.alias("host")).distinct().filter(~F.rlike("host", F.lit(ADDRESS)))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    child = F.explode(F.when(F.size(labels) > 2, F.slice(above, 1, F.size(labels) - 2)).otherwise(F.array()))
    tree = named.select(child.alias("child")).distinct().select("child", F.regexp_replace("child", r"^[^.]*\.", "").alias("parent"))
    tree = tree.filter(~F.rlike("parent", F.lit(PUBLIC))).union(ported)
    both = tree.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(tree.select("parent", "child"))
    every = linked.union(both.withColumn("weight", F.lit(1.0)))
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of all hosts reached.

    ``seeds`` has (host, trust, distrust), parts of 1. Trust runs from ``src`` to ``dst``, distrust back. Iterations run in a
    ``steady`` session: a round is one job, each iteration in it one shuffle, with a task for every ``STEPS`` steps.
    """
    def normal(src: str, dst: str, kind: str) -> DataFrame:
        total = edges.groupBy(src).agg(F.sum("weight").alias("total"))
        return edges.join(total, src).select(
            F.lit(kind).alias("kind"), F.col(src).alias("host"), F.col(dst).alias("to"), (F.col("weight") / F.col("total")).alias("share"))

    spark = edges.sparkSession
    loop = steady(spark)
    steps = stored(normal("src", "dst", "trust").union(normal("dst", "src", "distrust")), "steps", loop)
    start = stored(seeds.select("host", F.explode(F.create_map(
        F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).filter("seed > 0"), "seeds", loop)
    loop.conf.set("spark.sql.shuffle.partitions", 1 + (steps.count() + start.count()) // STEPS)
    given = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))
    ranks, change = start.select("kind", "host", F.col("seed").alias("rank")), float("inf")
    while change > tolerance:
        known = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("known"))
        for left in reversed(range(ROUND)):
            # sums leave ranks where the join wants them, and a host has one rank, whatever its steps: steps go by, ranks are held
            carried = steps.join(ranks, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            ranks = carried.union(given)
            if not left:
                ranks = ranks.withColumn("known", F.lit(0.0)).union(known)
            ranks = ranks.groupBy("kind", "host").agg(*[F.sum(c).alias(c) for c in ranks.columns[2:]])
        settled = stored(ranks, "ranks")
        part = F.abs(F.col("rank") - F.col("known")) / F.greatest("rank", "known")
        change = settled.filter("greatest(rank, known) > 0").agg(F.max(part)).first()[0] or 0.0
        ranks = settled.drop("known")
    whole = {r["kind"]: r["whole"] for r in ranks.groupBy("kind").agg(F.sum("rank").alias("whole")).collect()}
    by_kind = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))) / whole.get(k, 1.0), F.lit(0.0)).alias(k)
               for k in ("trust", "distrust")]
    return stored(ranks.groupBy("host").agg(*by_kind), "ranked", spark)


def judge(
    pages: DataFrame, *, url: str = "url", html: str = "html", rules: Sequence[tuple[str, str]] = RULES, ratio: float = RATIO,
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """Columns ``keep`` of every page with host, path, rule, verdict, trust and distrust (of its host)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(*[F.col(c).alias(f"_{c}") for c in keep], host.alias("host"), path.alias("path")).withColumns(
        {"rule": rule, "_verdict": verdict})
    count = [F.sum(F.when(F.col("_verdict") == v, 1.0).otherwise(0.0)).alias(n) for v, n in (("allow", "trust"), ("block", "distrust"))]
    judged = stored(rows.filter("rule is not null").groupBy("host").agg(*count), "judged")
    total = judged.agg(*[F.greatest(F.coalesce(F.sum(n), F.lit(0.0)), F.lit(1.0)).alias(f"all_{n}") for n in ("trust", "distrust")]).first()
    seeds = judged.select("host", (F.col("trust") / total[0]).alias("trust"), (F.col("distrust") / total[1]).alias("distrust"))
    edges = edges_of(pages.select(host.alias("host"), F.col(html).alias("html")))
    ranks = spread(stored(edges, "edges"), seeds)
    # without trust any distrust blocks
    above = F.round(F.col("distrust") / (ratio * F.col("trust")), RATIO_DECIMALS) > 1
    blocked = F.coalesce(F.when(F.col("trust") > 0, above).otherwise(F.col("distrust") > 0), F.lit(False))
    return rows.join(ranks, "host", "left").select(
        *[F.col(f"_{c}").alias(c) for c in keep], "host", "path", "rule",
        F.coalesce("_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
