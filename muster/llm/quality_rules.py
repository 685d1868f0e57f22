"""Quality rules: a decision list learned by sequential covering.

Rules for unwanted documents are grown one after the other from labelled statistics. A rule starts empty and takes the
threshold condition of the largest FOIL gain on two thirds of the rows that are left, until it covers no wanted row or gains
nothing; then conditions are cut off its end while that does not lower its worth on the other third. A rule that is precise
enough there joins the list, the rows it covers leave, and the next is grown, until no unwanted row is left or the next rule is
not precise enough: nothing else ends the list. It becomes one ordered ``CASE WHEN``.

The labelled rows are a bounded sample (``MAX_ROWS``), the verdicts cover all rows and whole texts. Texts without words fail
the base rules. Without labels of both kinds the list is empty and only the base rules judge. Repeated documents are judged
row by row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.columns import spare
from muster.llm.statistics import FEATURES, labelled, statistics

#: Labelled rows that are learned from at most.
MAX_ROWS = 20_000
MAX_CONDITIONS, CUTS = 4, 48
#: Share of unwanted rows among those a rule covers, in growing and in pruning rows alike.
PRECISION = 0.9
#: Rows a rule covers at least, of both parts together.
LEAST_COVERED = 5


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, stats: Column) -> Column:
        own = stats[self.feature].cast("double")
        return own > self.cut if self.above else own <= self.cut


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray, cuts: dict[str, np.ndarray]) -> Condition | None:
    """The condition of the largest FOIL gain among the rows inside."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    base, best, most = np.log2(max(p0, 1e-9) / (p0 + n0)), None, 1e-9
    for feature, values in cuts.items():
        bins = np.searchsorted(values, x[feature][inside], "left")  # bin k holds values <= cut k
        up = np.bincount(bins[bad[inside]], minlength=len(values) + 1).cumsum()[:-1]
        un = np.bincount(bins[~bad[inside]], minlength=len(values) + 1).cumsum()[:-1]
        for above, p, n in ((False, up, un), (True, p0 - up, n0 - un)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1.0)
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > most:
                best, most = Condition(feature, above, float(values[k])), float(gain[k])
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Rules of up to ``conditions`` conditions that cover bad rows.

    ``part`` is True for rows that rules grow on, False for those they are pruned on. Each rule takes ``LEAST_COVERED`` rows or
    more away, so the list ends.
    """
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 1)[:-1])) for f, v in x.items() if len(v)}
    left, rules = np.ones(len(bad), bool), []
    while (bad & left & part).any():
        rule: Rule = ()
        inside = left & part
        while len(rule) < conditions and (~bad & inside).any():
            best = _best_condition(x, bad, inside, cuts)
            if best is None:
                break
            rule, inside = (*rule, best), inside & best.holds(x)

        def worth(own: Rule) -> float:
            inside = _covers(own, x, len(bad)) & left & ~part
            p, n = int((bad & inside).sum()), int((~bad & inside).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside = _covers(rule, x, len(bad)) & left
        good = [(bad & inside & s).sum() >= PRECISION * (inside & s).sum() for s in (part, ~part)]
        if not rule or not all(good) or inside.sum() < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = F  # conditions are added side by side, not one inside the other
    for k, rule in enumerate(rules, 1):
        held = reduce(Column.__and__, [c.column(stats) for c in rule])
        out = out.when(held, F.lit(k))
    return out if rules else F.lit(None).cast("int")


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = MAX_ROWS, conditions: int = MAX_CONDITIONS, **names) -> list[Rule]:
    """A decision list from ``labels.quality``: what is covered is unwanted."""
    sample = labelled(documents, labels, "quality", rows, **names)
    own = sample.select("doc_id", "label", statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*")
    table = own.select("doc_id", "label", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)).alias("part"), *FEATURES).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    bad = table["label"].to_numpy() < 0.5
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn({f: table[f].to_numpy(np.float64) for f in FEATURES}, bad, table["part"].to_numpy() > 0, conditions)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def judge(documents: DataFrame, rules: list[Rule], *, text: str = "text", out: str = "quality") -> DataFrame:
    """``documents`` with a struct ``out`` (one of that name is replaced): statistics, base_failed, rule and kept."""
    name = spare(documents, "own_statistics")
    stats = F.col(name)
    own = documents.withColumn(name, statistics(F.col(text)))
    rule = verdict(rules, stats)
    own = own.withColumn(out, F.struct(
        stats.alias("statistics"), base_failed(stats).alias("base_failed"), rule.alias("rule"),
        (~base_failed(stats) & rule.isNull()).alias("kept")))
    return own.drop(name)
