from __future__ import annotations

import random
import re

import odd
import pytest
import xxhash
from pyspark.sql import functions as F

from muster.llm import graph, simhash


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, reach=2):
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= reach:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints_and_components_equal_brute_force(spark):
    own = odd.rows()
    base = own[5][1].split(" ")
    for k in range(25):  # near copies
        words = list(base)
        words[(7 * k) % len(words)] = f"other{k}"
        own.append((300 + k, " ".join(words), "en", "s0", 1, "", "", ""))
    got = simhash.near_duplicates(odd.documents(spark, own)).collect()
    prints = [brute(r[1]) for r in own]
    assert sorted((r.doc_id, r.fp) for r in got if r.doc_id is not None) == sorted(
        (r[0], signed(p)) for r, p in zip(own, prints, strict=True) if r[0] is not None)
    root = groups(prints)
    least = {}
    for r, p in zip(own, prints, strict=True):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    for r in got:
        assert r.component_id == least.get(root[r.fp % (1 << 64)])


@pytest.mark.parametrize("short", [1, 3, 64])
@pytest.mark.parametrize("reach", [0, 1, 2])
def test_links_connect_exactly_what_is_within_reach(spark, short, reach):
    rng = random.Random(short + reach)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randint(0, 12)):  # chains and balls around a value
            v ^= 1 << rng.randrange(64)
            values.add(v)
            values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    edges = simhash.links(prints, reach, short)
    assert edges.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) > reach).count() == 0
    root = {r.node: r.root for r in graph.components(edges).collect()}
    expected = groups(values, reach)
    byroot: dict = {}
    for v in values:
        byroot.setdefault(expected[v], set()).add(signed(v))
    for own in byroot.values():
        assert {root.get(v, v) for v in own} == {min(own)}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 51)}, **{100 + i: 100 for i in range(1, 40)}, 301: 300}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_row_of_each_group_stays(spark):
    documents = odd.documents(spark)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    own = kept.collect()
    prints = [brute(r.text) for r in own]
    assert len(prints) == len(set(groups(prints).values())) == len(set(groups([brute(r[1]) for r in odd.rows()]).values()))
    assert [r.doc_id for r in own].count(103) == 0 and [r.doc_id for r in own].count(1) == 1
    assert [r.doc_id for r in own if not brute(r.text)] == [100]
    assert simhash.keep_one(odd.empty(spark)).count() == 0 and simhash.near_duplicates(odd.empty(spark)).count() == 0
