"""The trie of conversations against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from muster.llm import prefix_trie
from muster.llm.prefix_trie import ROOT, SIZE, ZFastTrie, two_fattest

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    """Turns of each conversation as the operator orders them."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, mark, role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plainly(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, out = defaultdict(set), []
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def corpus(n=120, seed=2):
    """A first turn that a third share, deep chains, copies, nulls, ties, repeated rows and ids below zero."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        length = rng.choice([1, 2, 3, 5, 8, 30 if c % 20 == 0 else 4])
        turns = [(rng.choice(["user", None, "bot"]), rng.choice(["hi", "", None, "wie geht's", "日本"])) for _ in range(length)]
        if c % 3 == 0:
            turns[0] = ("user", "Hello")
        if c % 10 == 9:
            turns = [("user", "Hello"), ("bot", "copy")]
        numbers = rng.sample(range(100), length)
        rows += [(c - 10, m, *t) for m, t in zip(numbers, turns[:length], strict=False)]
    rows += [(500, None, "user", "first"), (500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (None, 0, "user", "lost")]
    rows += [(c, 0, "user", "alone") for c in (701, 702, 703, 704)]
    return rows + [(600, i, "user", "again " * (i % 2)) for i in range(300)] + [(601, i, "user", "again " * (i % 2)) for i in range(290)]


@pytest.mark.parametrize("held", [prefix_trie.HELD, 4])
def test_equals_the_plain_version(spark, held):
    rows = corpus()
    whole = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(prefix_trie.trie(whole, held)) == plainly(in_order(rows))


def test_openings_of_other_conversations(spark):
    rows = corpus()
    whole = prefix_trie.with_openings(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA)))
    convs = rebuilt(in_order(rows))
    assert any(not turns for turns in convs.values())  # turnless ones are members of the root
    assert found(prefix_trie.trie(whole)) == plainly(convs)


def test_many_copies_of_one_conversation(spark):
    rows = [(c, d, "user", f"turn {d}") for c in range(3000) for d in range(3)] + [(5000, 0, "user", "other")]
    out = found(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))))
    assert out == plainly(in_order(rows))


def test_empty_table_and_clashing_names(spark):
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = corpus(20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS path", "'x' AS print", "3 AS bytes", "4 AS owner")
    assert found(prefix_trie.trie(prefix_trie.sequences(df))) == plainly(in_order(rows))


def test_role_and_text_are_kept_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, None, "abc"), (4, 0, "", "abc")]
    out = found(prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))))
    assert out == plainly(in_order(rows)) and len(out) == 4


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 80):
            fat = two_fattest(low, high)
            assert low < fat <= high
            assert all(n & -n <= fat & -fat for n in range(low + 1, high + 1))


def test_fat_binary_search_finds_every_exit():
    rng = random.Random(8)
    keys = ["".join(rng.choices("ab", k=rng.randint(0, 40))) for _ in range(150)]
    keys += [k + "".join(rng.choices("abc", k=rng.randint(0, 9))) for k in keys]

    def path(key):
        return b"".join(hashlib.blake2b(key[:d].encode(), digest_size=SIZE).digest() for d in range(1, len(key) + 1))

    built, seen = ZFastTrie(), set()
    for i, key in enumerate(keys):
        built.insert(path(key), [1] * len(key), 1, i)
        seen.add(key)
        probe = rng.choice(keys)
        shared = max(d for k in seen for d in range(len(probe) + 1) if k[:d] == probe[:d])
        node, depth = built.exit(path(probe), len(probe))
        assert depth == shared and (depth <= node.depth) and (depth > node.above)
    rows = {r[0]: r for r in built.expanded()}
    assert len(rows) == len({k[:d] for k in keys for d in range(len(k) + 1)})
    assert rows[ROOT][4] == len(keys)
    assert all(built.handles[n.handle()] is n for n in built.handles.values())
