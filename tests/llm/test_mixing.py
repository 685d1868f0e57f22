from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import odd
import pytest

from muster.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), limit=3):
    """Shares by weight; what a source can't take is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        rest, shares = total - sum(full.values()), sum(weight[s] for s in open_)
        target = {s: full.get(s, rest * weight[s] / shares if shares else 0.0) for s in order}
        over = [s for s in open_ if target[s] > limit * sizes[s]]
        if not over:
            return target
        full |= {s: limit * sizes[s] for s in over}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _mixed(spark, own):
    return mixing.mix(odd.documents(spark, own)).collect()


def test_targets_and_taken_words(spark):
    own = odd.rows(150)
    got = _mixed(spark, own)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r[0] or -1, size(r[1])) for r in own)
    sizes = defaultdict(int)
    for r in own:
        sizes[r[3]] += size(r[1])
    target = plain_targets(sizes)
    by_size = {round(v, 6) for v in target.values()}
    taken = defaultdict(int)
    for r in got:
        assert round(r.target, 6) in by_size and 0 <= r.copies <= 3
        taken[round(r.target, 6)] += r.copies * r["size"]
    for t in by_size:
        same = sum(1 for v in target.values() if round(v, 6) == t)
        assert abs(taken[t] - t * same) <= max(30, 0.005 * t), (t, taken[t])
    again = _mixed(spark, own[::-1])
    assert Counter((r.doc_id, r["size"], r.copies) for r in got) == Counter((r.doc_id, r["size"], r.copies) for r in again)


def test_rates_are_the_tilted_solution(spark):
    """Of rates that meet a target, exponentials of the size (cut off at the limit) are those nearest to 1 in entropy."""
    rng = random.Random(3)
    own = [(i, " ".join(["w"] * rng.randint(1, 200)), "en", "a" if i < 60 else "b", 0, "", "", "") for i in range(300)]
    got = _mixed(spark, own)
    for target in {r.target for r in got}:
        rows = [r for r in got if r.target == target]
        assert math.isclose(sum(r.rate * r["size"] for r in rows), target, rel_tol=1e-5)
        free = [(r["size"], math.log(r.rate)) for r in rows if r.rate < 3 * (1 - 1e-9)]
        slopes = [lr / n for n, lr in free]
        if slopes:
            assert max(slopes) - min(slopes) <= 1e-9 + 1e-6 * max(map(abs, slopes))
            assert all(r["size"] * slopes[0] >= math.log(3) - 1e-6 for r in rows if r.rate >= 3 * (1 - 1e-9))


@pytest.mark.parametrize("n", [1, 2, 7])
def test_a_hot_size_is_dealt_exactly(spark, n):
    own = [(i, "one two", "en", "a", 0, "", "", "") for i in range(600)] + [(1000 + i, "x " * 50, "en", "b", 0, "", "", "") for i in range(n)]
    got = _mixed(spark, own)
    for target in {r.target for r in got}:
        assert abs(sum(r.copies * r["size"] for r in got if r.target == target) - target) <= 50


def test_mixed_documents(spark):
    documents = odd.documents(spark)
    got = mixing.mixed(documents.withColumnRenamed("rate", "copies"))
    assert got.columns == [c for c in documents.columns if c != "rate"] + ["copies"]
    rows = got.collect()
    copies = Counter()
    for r in mixing.mix(documents).collect():
        copies[r.doc_id] += r.copies
    assert {r.doc_id: r.copies for r in rows} == {k: v for k, v in copies.items() if v}
    assert mixing.mixed(odd.empty(spark)).count() == 0 and mixing.mix(odd.empty(spark)).count() == 0
    wordless = odd.documents(spark, [(1, None, "en", "a", 0, "", "", ""), (2, " ", "en", None, 0, "", "", "")])
    assert [(r["size"], r.target, r.copies) for r in mixing.mix(wordless).collect()] == [(0, 0.0, 0)] * 2
