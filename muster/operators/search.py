"""Substring search by trigrams: the rows that can hold a term are looked up instead of scanned.

Postings say which employees have which three letters in which field, sorted by the letters, so that a lookup reads only the row
groups of a term's trigrams. Employees that have all of them in one field are candidates, and are verified by the search itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import ascii_lower
from muster.operators.employees import clean_argument, search_employees
from muster.sources import snapshots

FIELDS = ("first_name", "last_name", "matricule")
SIZE = 3


def postings(employees: DataFrame) -> DataFrame:
    """(gram, field, matricule): every three letters of every searched field, once an employee."""
    def grams(field: str):
        text = ascii_lower(f"cast({field} AS STRING)")
        own = F.expr(f"transform(sequence(1, greatest(length({text}) - {SIZE - 1}, 1)), i -> substring({text}, i, {SIZE}))")
        return F.struct(F.lit(field).alias("field"), F.array_distinct(own).alias("grams"))

    each = employees.select("matricule", F.explode(F.array(*[grams(f) for f in FIELDS])).alias("x"))
    rows = each.select(F.explode("x.grams").alias("gram"), "x.field", "matricule")
    return rows.filter((F.length("gram") == SIZE) & F.col("matricule").isNotNull())


def index(employees: DataFrame, path: str) -> DataFrame:
    """Store the postings. Ranges are of letters and employee, so the commonest letters are no task of their own."""
    rows = postings(employees).distinct().repartitionByRange("gram", "matricule").sortWithinPartitions("gram", "matricule")
    rows.write.mode("overwrite").parquet(path)
    return read_index(employees.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gram string, field string, matricule bigint").parquet(path)


def indexable(term: str | None) -> bool:
    """Wildcards and terms of fewer letters than a trigram need the scan."""
    return term is not None and len(term) >= SIZE and not set(term) & set("%_")


def candidates(stored: DataFrame, term: str) -> DataFrame:
    """(matricule) of the employees that have all trigrams of a cleaned term in one field."""
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in term)
    grams = sorted({text[i:i + SIZE] for i in range(len(text) - SIZE + 1)})
    held = stored.filter(F.col("gram").isin(grams)).groupBy("field", "matricule").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") == len(grams)).select("matricule").distinct()


def search(employees: DataFrame, stored: DataFrame, term: str | None) -> DataFrame:
    """What ``search_employees`` finds, through the postings where the term allows it.

    The postings must be of these employees; those without a matricule are found by the scan only.
    """
    cleaned = clean_argument(term)
    if not indexable(cleaned):
        return search_employees(employees, term)
    keyed = employees.join(candidates(stored, cleaned), "matricule", "left_semi")
    return search_employees(keyed, term)


def search_snapshot(spark: SparkSession, path: str, index_path: str, term: str | None, version: int | None = None) -> DataFrame:
    """Search a versioned snapshot of employees; only buckets that candidates lie in are read.

    Postings are stored per version under ``index_path`` and built when a version is searched for the first time.
    """
    version = snapshots.newest(spark, path) if version is None else version
    at = f"{index_path}/{version:08}"
    try:
        stored = read_index(spark, at)
        stored.isEmpty()
    except AnalysisException:
        stored = index(snapshots.read(spark, "employees", path, version), at)
    cleaned = clean_argument(term)
    if not indexable(cleaned):
        return search_employees(snapshots.read(spark, "employees", path, version), term)
    found = candidates(stored, cleaned)
    rows = snapshots.read_buckets(spark, "employees", path, found, version)
    return search_employees(rows.join(found, "matricule", "left_semi"), term)
