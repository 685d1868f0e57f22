"""Boosting and forests against plain versions that look at every row and every split."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import plan, rows

from muster.operators import boosting, forest
from muster.operators.boosting import Boosting
from muster.operators.forest import Forest

FEATURES = ["a", "b", "c"]
SPEC = Boosting(rounds=7, rate=0.3, depth=3, child_weight=2.0, rows=0.8, columns=0.7, alpha=1.5, lam=0.5)


def table(spark, n=120, seed=4):
    rng = random.Random(seed)
    data = [(float(rng.randint(0, 20)), rng.choice([None, 0.5, 1.5, 2.5]), float(rng.randint(0, 3))) for _ in range(n)]
    data = [(*x, 10 * x[0] - 7 * (x[1] or -1) * x[2] + rng.randint(-9, 9)) for x in data]
    return spark.createDataFrame([*data, *data[:5], (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double").cache()


def nodes_of(model):
    return sorted(rows(model.nodes.select("tree", "node", "feature", "threshold", "left", "value", "gain", "cover")))


def plain_tree(x, y, margin, spec, columns, used):
    """The tree of one round, each split found by trying all values of all columns on all rows."""
    def score(own):
        g = sum(margin[i] - y[i] for i in own)
        return math.copysign(max(abs(g) - spec.alpha, 0.0), g), len(own) + spec.lam

    out, level = {}, [(0, [i for i in range(len(y)) if used[i]])]
    number = 1
    for depth in range(spec.depth + 1):
        below = []
        for node, own in level:
            g, h = score(own)
            best = None
            for f in columns if depth < spec.depth else []:
                for at in sorted({v for v in x[:, f] if v > -math.inf}):
                    left, right = [i for i in own if x[i, f] <= at], [i for i in own if x[i, f] > at]
                    if min(len(left), len(right)) < max(spec.child_weight, 1):
                        continue
                    (lg, lh), (rg, rh) = score(left), score(right)
                    gain = (lg * lg / lh + rg * rg / rh - g * g / h) / 2
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, at, left, right)
            if best and best[0] > 1e-9:
                out[node] = (best[1], best[2], number, 0.0, best[0], len(own))
                below += [(number, best[3]), (number + 1, best[4])]
                number += 2
            else:
                out[node] = (-1, None, 0, -spec.rate * g / h, 0.0, len(own))
        level = below
    return out


def plain_boosting(x, y, marks, spec):
    margin, trees = np.full(len(y), y.mean()), []
    for round_ in range(spec.rounds):
        columns = boosting.drawn_columns(x.shape[1], spec, round_)
        tree = plain_tree(x, y, margin, spec, columns, boosting.drawn(marks, spec, round_))
        for i in range(len(y)):
            node = 0
            while tree[node][0] >= 0:
                node = tree[node][2] + (x[i, tree[node][0]] > tree[node][1])
            margin[i] += tree[node][3]
        trees.append(tree)
    return trees


def test_boosting_grows_the_trees_of_a_plain_version(spark):
    df = table(spark)
    model = boosting.fit(df, SPEC, FEATURES, "y", "monthly")
    known = [r for r in rows(df) if r[3] is not None]
    values = np.array([[-math.inf if v is None else v for v in r[:3]] for r in known])
    y = np.array([r[3] for r in known])
    cuts = [sorted({v for v in c if v > -math.inf}) for c in values.T]
    bins = np.stack([np.searchsorted(c, v) * (v > -math.inf) for c, v in zip(cuts, values.T, strict=True)], 1)
    order = np.lexsort([y, *bins.T[::-1]])  # as the task has them, so that equal rows get the same marks
    held = boosting.Rows(bins[order].astype(np.int32), y[order], 0.0)
    expected = plain_boosting(values[order], y[order], held.marks, SPEC)
    got = nodes_of(model)
    assert [(r[0], r[1], r[2], r[3], r[4], r[7]) for r in got] == [
        (t, n, v[0], v[1], v[2], v[5]) for t, tree in enumerate(expected) for n, v in sorted(tree.items())]
    assert [r[5] for r in got] == pytest.approx([v[3] for tree in expected for _, v in sorted(tree.items())], rel=1e-9, abs=1e-9)
    assert [r[6] for r in got] == pytest.approx([v[4] for tree in expected for _, v in sorted(tree.items())], rel=1e-9, abs=1e-9)
    assert len(got) > 7 * 5


def test_penalties_change_leaves():
    sums = np.array([[5.0, -5.0, 1.0]])
    assert boosting.shrunk(sums, 2.0).tolist() == [[3.0, -3.0, 0.0]]
    assert boosting.gain_of(np.array([5.0]), np.array([2.0]), Boosting(1, 1, 1, alpha=2.0, lam=1.0)).tolist() == [3.0]


def test_tasks_side_by_side_find_the_same_splits(spark):
    spec = Boosting(rounds=2, rate=0.5, depth=2, bins=64)
    one, two = (boosting.fit(table(spark), spec, FEATURES, "y", "monthly", tasks=n) for n in (1, 2))
    assert [r[:5] for r in nodes_of(one)] == [r[:5] for r in nodes_of(two)]
    assert [r[5] for r in nodes_of(one)] == pytest.approx([r[5] for r in nodes_of(two)])


def test_killed_training_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    df, path = table(spark), str(tmp_path / "training")
    whole = boosting.fit(df, SPEC, FEATURES, "y", "monthly", segment=3)
    run, calls = boosting._segment, []

    def killed(*args):
        calls.append(args[-1])
        if len(calls) == 2:
            raise RuntimeError("killed")
        return run(*args)

    monkeypatch.setattr(boosting, "_segment", killed)
    with pytest.raises(RuntimeError):
        boosting.fit(df, SPEC, FEATURES, "y", "monthly", path, segment=3)
    again = boosting.fit(df, SPEC, FEATURES, "y", "monthly", path, segment=3)
    assert calls == [range(0, 3), range(3, 6), range(3, 6), range(6, 7)]
    assert nodes_of(again) == nodes_of(whole)  # to the last bit
    with pytest.raises(ValueError):
        boosting.fit(df, Boosting(rounds=9, rate=0.3, depth=3), FEATURES, "y", "monthly", path)


def walked(nodes, x, base):
    total = base
    for tree in sorted({r[0] for r in nodes}):
        own = {r[1]: r for r in nodes if r[0] == tree}
        node = 0
        while own[node][2] >= 0:
            v = x[own[node][2]]
            node = own[node][4] + (v is not None and (v != v or v > own[node][3]))
        total += own[node][5]
    return total


def test_scoring_equals_a_plain_walk_to_the_last_bit(spark):
    model = boosting.fit(table(spark), SPEC, FEATURES, "y", "monthly")
    odd = [(None, None, None), (math.nan, 1.0, 2.0), (math.inf, -math.inf, 0.0), (5.0, 1.5, math.nan), (20.0, 0.5, 3.0), (6.0, 2.5, 1.0)]
    df = spark.createDataFrame(odd, "a double, b double, c double").selectExpr("*", "'x' AS m", "1 AS n", "2 AS r")
    nodes = nodes_of(model)
    for row in model.predict(df).collect():
        assert row["prediction"] == walked(nodes, row[:3], model.base) and row["m"] == "x"
    text = plan(model.predict(df))
    assert not any(word in text for word in ("EvalPython", "MapInArrow", "UDF"))
    assert sum(r[1] for r in rows(model.importance(spark))) == pytest.approx(1.0)


def plain_forest(x, draws):
    """Trees over (mark, weight, y) by the greatest drop of squared error, first feature and value on a tie."""
    out = []
    for tree, own in sorted(draws.items()):
        level, number = [(0, own)], 1
        while level:
            below = []
            for node, part in level:
                c, s = sum(w for _, w, _ in part), sum(w * y for _, w, y in part)
                best = None
                if len({y for *_, y in part}) > 1:
                    for f in range(x.shape[1]):
                        for at in sorted({x[m, f] for m, *_ in part} - {-math.inf} | ({-math.inf} & {x[m, f] for m, *_ in part}))[:-1]:
                            left = [p for p in part if x[p[0], f] <= at]
                            cl, sl = sum(w for _, w, _ in left), sum(w * y for _, w, y in left)
                            gain = sl * sl / cl + (s - sl) * (s - sl) / (c - cl) - s * s / c
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, at)
                if best is None:
                    out.append((tree, node, -1, s / c, c))
                    continue
                out.append((tree, node, best[1], s / c, c))
                below += [(number + k, [p for p in part if (x[p[0], best[1]] > best[2]) == bool(k)]) for k in (0, 1)]
                number += 2
            level = below
    return out


def test_forest_equals_a_plain_version_given_its_draws(spark, monkeypatch):
    spec, held = Forest(trees=4, bins=64), []
    drawn = forest.drawn
    monkeypatch.setattr(forest, "drawn", lambda *a: held.append(drawn(*a)) or held[-1])
    df = table(spark, 60)
    model = forest.fit(df, spec, FEATURES, "y", "monthly")
    x, draws = {}, {}
    for mark, bins, y, tree, w in rows(held[0].select("mark", "x", "y", "tree", "w")):
        x[mark] = bins
        draws.setdefault(tree, []).append((mark, w, y))
    places = {m: i for i, m in enumerate(sorted(x))}
    draws = {t: sorted((places[m], w, y) for m, w, y in own) for t, own in draws.items()}
    expected = plain_forest(np.array([x[m] for m in sorted(x)], float), draws)
    got = [(r[0], r[1], r[2], r[5], r[7]) for r in nodes_of(model)]
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected)]
    assert [g[3] for g in got] == pytest.approx([e[3] for e in sorted(expected)])
    weights = [w for own in draws.values() for _, w, _ in own]
    assert 0.8 < sum(weights) / (4 * len(x)) < 1.2


def test_forest_has_no_depth_limit(spark):
    """Values that halve the error only one at a time need a tree as deep as the table is long."""
    df = spark.createDataFrame([(float(i), 4.0**i) for i in range(45)], "a double, y double")
    model = forest.fit(df, Forest(trees=1, bins=64), ["a"], "y", "monthly")
    leaves = model.nodes.filter("feature < 0")
    assert model.nodes.agg({"depth": "max"}).first()[0] > 15
    drawn = leaves.count()
    assert drawn == model.predict(df).select("prediction").distinct().count() > 20


def test_models_of_empty_tables(spark):
    df = table(spark).limit(0)
    assert boosting.fit(df, SPEC, FEATURES, "y", "monthly").predict(table(spark)).filter("prediction <> 0").isEmpty()
    assert forest.fit(df, Forest(trees=2), FEATURES, "y", "monthly").predict(table(spark)).filter("prediction IS NOT NULL").isEmpty()
