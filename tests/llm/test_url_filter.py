from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from muster.llm import url_filter as uf
from muster.llm.queries import ORACLES

PAGES = [
    (1, "http://WWW.Example.com/en/x?q=/en/", "<a href='http://deep.other.org/a'>x</a>"), (2, "https://m.example.com/en/", None),
    (3, "http://a.b.net/es/1", '<a HREF = "//friend.org/x#y">'), (4, "http://a.b.net/en/1", ""), (5, "http://c.net/fr/", "<a href='/es/'>"),
    (6, "ftp://friend.org", '<a href="http://a.b.net/es/">'), (7, "http://deep.other.org/z", ""), (8, None, "x"), (9, "", None),
    (10, "no scheme/en/", '<a href="http://c.net">'), (11, "http://com/", ""), (12, "http://x.com", ""), (13, "http://notexample.com/en/", ""),
    (14, "http://example.com/en", ""), (15, "http:///en/", ""), (16, "http://h.org#frag/../", ""), (17, "a://b://c/d", ""),
    (18, "http://b.net/de/", '<a href="https://A.B.net/">'), (3, "http://a.b.net/es/1", '<a HREF = "//friend.org/x#y">'), (None, "http://É.com/\n", ""),
    (20, "http://far.away.museum/", ""), (21, "http://example.com/en/?x", ""),
]
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


REGISTRIES = {"ac", "co", "com", "edu", "go", "gob", "gov", "ne", "net", "or", "org"}


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fits = [(len(r), v, r) for v, r in RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def brute(pages):
    own = [host_path(p[1]) for p in pages]
    weight = defaultdict(float)
    for (host, _), (_, _, html) in zip(own, pages, strict=True):
        for link in re.findall(r"""(?i)\shref\s*=\s*["']\s*((?:https?:)?//[^"'\s>]*)""", html or ""):
            to = host_path(link if "://" in link else "http:" + link)[0]
            if host and to and to != host:
                weight[host, to] += 1
    tree = set()
    for h in {h for h, _ in own if h} | {d for _, d in weight}:
        bare = re.sub(r":[0-9]*\Z", "", h)
        if bare and bare != h:
            tree.add((h, bare))
        labels = bare.split(".")
        if ":" in bare or "[" in bare or "]" in bare or all(c in "0123456789." for c in bare):
            continue
        while len(labels) > 2:
            registry = len(labels) == 3 and labels[1] in REGISTRIES and re.fullmatch("[a-z]{2}", labels[2])
            if not registry:
                tree.add((".".join(labels), ".".join(labels[1:])))
            labels = labels[1:]
    for a, b in tree:
        weight[a, b] += 1
        weight[b, a] += 1
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), w in weight.items():
        out[a] += w
        into[b] += w
    seeds = {"allow": defaultdict(float), "block": defaultdict(float)}
    for h, p in own:
        if rule(h, p)[0]:
            seeds[rule(h, p)[0]][h] += 1
    ranks = {}
    for v, seed in seeds.items():
        total = sum(seed.values()) or 1
        seed = {h: n / total for h, n in seed.items()}
        rank, change = dict(seed), 1.0
        while change > 1e-13:  # what arrives at hosts without onward edges goes back to the seeds
            lost = sum(r for h, r in rank.items() if not (out if v == "allow" else into)[h])
            fresh = defaultdict(float, {h: (1 - uf.DAMPING + uf.DAMPING * lost) * s for h, s in seed.items()})
            for (a, b), w in weight.items():
                src, dst, share = (a, b, w / out[a]) if v == "allow" else (b, a, w / into[b])
                fresh[dst] += uf.DAMPING * rank.get(src, 0) * share
            reached = [h for h, r in fresh.items() if r > 0]
            change = max((abs(fresh[h] - rank.get(h, 0)) / fresh[h] for h in reached), default=0.0)
            rank = fresh
        ranks[v] = rank
    result = []
    for (h, p), page in zip(own, pages, strict=True):
        v, r = rule(h, p)
        t, d = (ranks[k].get(h, 0.0) for k in ("allow", "block"))
        above = round(d / t, uf.RATIO_DECIMALS) > 1 if t else d > 0
        result.append((page[0], h, p, r, v or ("block" if above else "allow"), t, d))
    return result


def key(r):
    return tuple(str(x) for x in r)


def test_verdicts_equal_brute_force(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, host string")
    got = uf.judge(pages)
    rows = [tuple(r)[:5] for r in got.collect()]
    assert sorted(rows, key=key) == sorted([r[:5] for r in brute(PAGES)], key=key)
    by_id = {r[0]: r for r in rows}
    assert by_id[1][3:] == ("www.example.com/en/", "allow") and by_id[2][3:] == ("example.com/en/", "block")
    assert by_id[4][3:] == (None, "block") and by_id[20][4] == "allow" and by_id[8][1:] == ("", "", None, "allow")
    assert by_id[12][3] is None and by_id[11][3] == "com/"
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in shown and "Arrow" not in shown


def test_no_seeds_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", None), (2, None, None)], "page_id bigint, url string, html string")
    assert {r.verdict for r in uf.judge(pages).collect()} == {"allow"}
    assert uf.judge(pages.filter("page_id < 0")).count() == 0


def test_verdicts_do_not_depend_on_distance_or_table_size(spark):
    """Hosts reached by distrust alone are blocked, 14 hops away and when many links and pages leave next to nothing of it."""
    own = [(0, "http://a.net/es/", "")] + [(900 + k, "http://big.net/es/", "") for k in range(200)]
    own += [(k, f"http://h{k}.org/", f"<a href='http://{f'h{k - 1}.org' if k > 1 else 'a.net'}/'>x</a>") for k in range(1, 15)]
    own += [(100 + k, f"http://g{k}.org/", f"<a href='http://{f'g{k - 1}.org' if k > 1 else 'a.net'}/'>x</a>") for k in range(1, 4)]
    own += [(200, "http://many.org/", "".join(f"<a href='http://g{k}.org/'>x</a>" * 3000 for k in (1, 2)))]
    pages = spark.createDataFrame(own, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    assert {got[k].verdict for k in [*range(1, 15), 101, 102, 103]} == {"block"}
    assert 0 < got[103].distrust < 1e-9 and got[103].trust == 0


def test_ranks_are_settled(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in uf.spread(edges, seeds).collect()}
    assert abs(got["a"] - 1 / 1.85) < 1e-6 and abs(got["b"] - 0.85 / 1.85) < 1e-6


def test_mass_of_hosts_without_links_goes_back_to_the_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in uf.spread(edges, seeds).collect()}
    assert abs(got["a"] - 1 / 1.85) < 1e-6 and abs(got["a"] + got["b"] - 1) < 1e-9


def _random_pages(seed):
    """Links at random, chains of 20 hosts that lead to either kind of seed, addresses, ports and registries."""
    rng = random.Random(seed)
    hosts = [f"h{k}.{rng.choice(['org', 'net', 'com', 'co.uk', 'x.org'])}" for k in range(25)]
    hosts += ["10.0.0.1", "10.0.0.2:8080", "[::1]:80", "sub.h1.info:81", "sub.h1.info", "a.b.co.uk", "com.au", "x.com.au"]
    links = [(rng.choice(hosts), rng.choice(hosts)) for _ in range(60)]
    for c, end in enumerate((hosts[0], "blocked.net", "a.com", "blocked.net")):
        chain = [f"chain{c}-{k}.info" for k in range(20)]
        links += list(zip(chain, [*chain[1:], end], strict=True))
    paths = ["", "/", "/en/", "/es/x", "/fr/?q"]
    pages = [(n, f"http://{a}{rng.choice(paths)}", f'<a href="http://{b}/">x</a>') for n, (a, b) in enumerate(links)]
    return [*pages, (900, "http://blocked.net/es/", ""), (901, "http://com/", ""), (902, "http://a.com/x", ""), (903, "http://com/", "<a href='//a.com'><a href='//both.info'>"),
            (904, "http://both.info/", "<a href='//blocked.net'><a href='//a.com'>")]


def test_settled_ranks_of_a_random_graph_equal_brute_force_and_sql(spark):
    own = _random_pages(2)
    pages = spark.createDataFrame(own, "page_id bigint, url string, html string")
    got = {r.page_id: tuple(r) for r in uf.judge(pages).collect()}
    want = {r[0]: r for r in brute(own)}
    assert {k: r[:5] for k, r in got.items()} == {k: r[:5] for k, r in want.items()}
    for k, r in want.items():
        assert got[k][5:] == pytest.approx(r[5:], rel=1e-5, abs=0)
    assert {r[4] for r in want.values()} == {"allow", "block"}
    assert any(r[5] > 0 and r[6] > 0 for r in want.values())
    with duckdb.connect() as db:
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?, ?)", own)
        twin = db.sql(ORACLES["op4_url_filter"])
        rows = [dict(zip(twin.columns, r, strict=True)) for r in twin.fetchall()]
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows} == {k: r[1:5] for k, r in want.items()}


def test_addresses_and_registries_link_no_owners(spark):
    rows = [(1, "http://10.0.0.1/", ""), (2, "http://shop.co.uk/", ""), (3, "http://bank.co.uk:8080/", ""), (4, "http://a.b.co.uk", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.src, r.dst) for r in uf.edges_of(pages.select(uf.host_of(F.col("url")).alias("host"), "html")).collect()}
    pairs = [("bank.co.uk:8080", "bank.co.uk"), ("a.b.co.uk", "b.co.uk")]
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}


def _exchange_threads(spark):
    names = [t.getName() for t in spark._jvm.Thread.getAllStackTraces().keySet()]
    return {n for n in names if n.startswith(("shuffle-exchange", "broadcast-exchange"))}


def test_iterations_leave_the_driver_no_threads(spark):
    """A thread for every shuffle and broadcast, each living on for a minute, took the driver past its memory."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double")
    before, settings = _exchange_threads(spark), spark.conf.getAll
    ranks = uf.spread(edges, seeds)
    assert len(_exchange_threads(spark) - before) < 20
    assert spark.conf.getAll == settings and ranks.sparkSession is spark


def test_ranks_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    own = _random_pages(3)
    pages = spark.createDataFrame(own, "page_id bigint, url string, html string")
    monkeypatch.setattr(uf, "STEPS", 20)
    got = {r.page_id: tuple(r) for r in uf.judge(pages).collect()}
    for r in brute(own):
        assert got[r[0]][:5] == r[:5] and got[r[0]][5:] == pytest.approx(r[5:], rel=1e-5, abs=0)
