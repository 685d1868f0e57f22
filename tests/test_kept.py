"""Trigram search, kept-up figures and key audits against the plain way of doing the same."""

from __future__ import annotations

import random
import re

import pytest
from conftest import SF_DIR, plan, rows
from pyspark.sql import functions as F

from muster.operators import audits, joins, kept, rollups, search
from muster.operators.employees import search_employees
from muster.sources import snapshots


def staff(spark):
    rng = random.Random(3)
    letters = "aAbBnNé%_.'#"
    data = [(i, "".join(rng.choices(letters, k=rng.randint(0, 6))) or None, "".join(rng.choices(letters, k=rng.randint(1, 8)))) for i in range(1, 400)]
    return spark.createDataFrame(data, "matricule bigint, first_name string, last_name string").cache(), rng


def test_indexed_search_equals_the_scan(spark, tmp_path):
    df, rng = staff(spark)
    held = search.index(df, str(tmp_path / "postings")).cache()
    terms = [r[2][i:i + n] for r in rng.sample(rows(df), 12) for n in (1, 3, 4) for i in (0, 1)]
    for term in [*terms, "12", "123", "39", " aab ", "", None, "zzz", "b%n", "a_b", "&", "<b>", "'an", "ABNA"]:
        assert sorted(rows(search.search(df, held, term)), key=repr) == sorted(rows(search_employees(df, term)), key=repr), term


def test_lookup_reads_few_row_groups(spark, tmp_path):
    df, _ = staff(spark)
    held = search.index(df, str(tmp_path / "postings"))
    assert "PushedFilters: [In(gram" in plan(search.candidates(held, "abna"))


def test_search_of_a_snapshot_follows_its_versions(spark, domain, tmp_path):
    path, at = str(tmp_path / "staff"), str(tmp_path / "postings")
    snapshots.create(domain.employees(), "employees", path, buckets=8)
    first = rows(search.search_snapshot(spark, path, at, "00012").select("matricule"))
    assert first == rows(search_employees(domain.employees(), "00012").select("matricule")) or sorted(first) == sorted(
        rows(search_employees(domain.employees(), "00012").select("matricule")))
    keys = spark.createDataFrame(first[:1], "matricule bigint")
    snapshots.change(spark, "employees", path, keys, lambda e: e.join(keys, "matricule", "left_anti"))
    assert sorted(rows(search.search_snapshot(spark, path, at, "00012").select("matricule"))) == sorted(first[1:])
    assert sorted(rows(search.search_snapshot(spark, path, at, "00012", version=1).select("matricule"))) == sorted(first)


def test_figures_after_any_sequence_of_batches_equal_recomputing(spark, domain, tmp_path):
    salary, departures, recruitments = domain.reduced().monthly_sources()
    rng = random.Random(9)
    for trial in range(2):
        path, batches = str(tmp_path / f"kept{trial}"), list(range(5)) + [rng.randint(0, 4) for _ in range(2)]
        rng.shuffle(batches)
        for b in batches:
            own = F.pmod(F.xxhash64("Year", "Month"), F.lit(5)) == b
            kinds = {"salary": salary, "departures": departures, "recruitments": recruitments}
            for kind in rng.sample(sorted(kinds), 3) if b == 4 else [None]:  # one batch comes source by source
                sources = kinds if kind is None else {kind: kinds[kind]}
                kept.add(spark, path, f"{b}-{kind}", **{k: df.filter(own) for k, df in sources.items()})
        merged = kept.merged(spark, path).cache()
        history = domain.historical()
        cents = [F.round("mass_salary", 2).alias("mass_salary")]
        assert sorted(rows(kept.historical(merged).select(*history.columns))) == sorted(rows(history))
        assert sorted(rows(kept.yearly_salary(merged).select("entity", "Year", *cents, "nbemp"))) == sorted(
            rows(rollups.yearly_salary(salary).select("entity", "Year", *cents, "nbemp")))
        assert sorted(rows(kept.yearly_departures(merged))) == sorted(rows(rollups.yearly_sum(departures, "nb_departures")))
        assert sorted(rows(kept.yearly_recruitments(merged))) == sorted(rows(rollups.yearly_sum(recruitments, "Recruitments")))


@pytest.mark.parametrize("most", [audits.MOST_CHUNKS, 1])
def test_orphans_by_bitmap(spark, most):
    parent = spark.createDataFrame([(x,) for x in (0, 1, 7, 8, 32767, 32768, -1, -40000, 2**62, None)], "id bigint")
    keys = [0, 1, 2, 7, 8, 9, 32767, 32768, 32769, -1, -2, -40000, 2**62, 2**62 + 1, None] + [5] * 300 + [7] * 300
    child = spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert sorted(rows(audits.orphans(child, "k", parent, "id", most))) == sorted(rows(joins.orphans(child, "k", parent, "id")))


def test_clean_rows_leave_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    text = plan(audits.orphans(df, "o_custkey", spark.read.parquet(f"{SF_DIR}/customer.parquet"), "c_custkey"))
    steps = [(name, int(number)) for number, name in re.findall(r"^\((\d+)\) (\w+)", text, re.M)]
    joined = [n for name, n in steps if name == "BroadcastHashJoin"]
    assert len(joined) == 1 and all(n > joined[0] for name, n in steps if name == "Exchange")


@pytest.mark.parametrize("slots", [64, 1 << 12])
def test_duplicates_by_slot(spark, slots):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice([None, "a", "b"]) if i % 50 == 0 else str(rng.randint(0, 4000)),) for i in range(2000)], "k string")
    assert sorted(rows(audits.duplicate_keys(df, "k", slots)), key=repr) == sorted(rows(rollups.duplicate_keys(df, "k")), key=repr)
