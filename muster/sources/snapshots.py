"""Versioned snapshots: keyed rows in buckets, changed by writing only the buckets a batch touches.

    <path>/data/version=<v>/bucket=<b>/      the rows of a bucket, as version v left them
    <path>/versions/<v>/                     the manifest of version v: which version's files each bucket has

A change reads the buckets that its keys fall into, writes them anew under the next version and then the manifest, one small file
that is there as a whole or not at all. Readers go by the newest manifest, so a failed job, whatever it wrote, is invisible, the
others see the version before until the new one is complete, and a job started again writes the same folder over. Two jobs that
change a table at once can't both publish: a manifest is never overwritten, the later one fails and may be run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.sources.tables import SCHEMAS, conform

#: Buckets of a new snapshot; each should be some hundred megabytes.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    try:
        return spark.read.schema("bucket int, version int, buckets int, key string").parquet(f"{path}/versions/{version:08}")
    except AnalysisException:
        return None


def newest(spark: SparkSession, path: str) -> int:
    """The newest complete version, 0 if there is none. Versions are numbered without gaps."""
    low, high = 0, 1
    while _manifest(spark, path, high) is not None:
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if _manifest(spark, path, middle) is not None else (low, middle)
    return low


def _publish(spark: SparkSession, path: str, version: int, files: dict[int, int], buckets: int, key: str) -> None:
    rows = [(b, v, buckets, key) for b, v in sorted(files.items())]
    df = spark.createDataFrame(rows, "bucket int, version int, buckets int, key string").coalesce(1)
    df.write.mode("errorifexists").parquet(f"{path}/versions/{version:08}")


def _write(rows: DataFrame, path: str, version: int, buckets: int, key: str) -> None:
    dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition(buckets, "bucket").sortWithinPartitions("bucket", key)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")


def create(df: DataFrame, name: str, path: str, key: str = "matricule", buckets: int = BUCKETS) -> DataFrame:
    """The first version of a snapshot, and its rows as stored."""
    spark = df.sparkSession
    if newest(spark, path):
        raise ValueError(f"{path} holds a snapshot already")
    _write(conform(df, SCHEMAS[name]), path, 1, buckets, key)
    _publish(spark, path, 1, dict.fromkeys(range(buckets), 1), buckets, key)
    return read(spark, name, path)


def _read(spark: SparkSession, name: str, path: str, files: dict[int, int]) -> DataFrame:
    """Rows of the given buckets, each in the given version. A bucket without rows has no folder."""
    schema = SCHEMAS[name]
    stored = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    found = spark.createDataFrame([], schema)
    for version in sorted(set(files.values())):
        own = sorted(b for b, v in files.items() if v == version)
        rows = spark.read.schema(stored).parquet(f"{path}/data/version={version}")
        found = found.union(rows.filter(F.col("bucket").isin(own)).select(*schema.fieldNames()))
    return found


def _files(manifest: DataFrame) -> tuple[dict[int, int], int, str]:
    rows = manifest.collect()
    return {r["bucket"]: r["version"] for r in rows}, rows[0]["buckets"], rows[0]["key"]


def read(spark: SparkSession, name: str, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is given."""
    manifest = _manifest(spark, path, newest(spark, path) if version is None else version)
    if manifest is None:
        raise FileNotFoundError(f"no version {version or ''} at {path}")
    return _read(spark, name, path, _files(manifest)[0])


def read_buckets(spark: SparkSession, name: str, path: str, keys: DataFrame, version: int | None = None) -> DataFrame:
    """The rows of the buckets that ``keys`` fall into; no other file is read."""
    files, buckets, key = _files(_manifest(spark, path, newest(spark, path) if version is None else version))
    touched = _touched(keys, key, buckets)
    return _read(spark, name, path, {b: files[b] for b in touched})


def _touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    return [r[0] for r in keys.filter(F.col(key).isNotNull()).select(_bucket(key, buckets).alias("b")).distinct().collect()]


def change(
    spark: SparkSession, name: str, path: str, keys: DataFrame, apply: Callable[[DataFrame], DataFrame], after: int | None = None,
) -> int:
    """Publish the next version: ``apply`` gets the rows of all buckets that ``keys`` (its column named like the table's key) fall
    into and returns what they become. Rows of other keys must stay as they are. Returns the version.

    ``after`` is the version the change was decided on; if another was published since, nothing is changed and the job fails.
    """
    version = newest(spark, path)
    if after is not None and after != version:
        raise ValueError(f"{path} is at version {version}, not {after}")
    files, buckets, key = _files(_manifest(spark, path, version))
    touched = _touched(keys, key, buckets)
    if not touched:
        return version
    before = _read(spark, name, path, {b: files[b] for b in touched})
    _write(conform(apply(before), SCHEMAS[name]), path, version + 1, buckets, key)
    _publish(spark, path, version + 1, {**files, **dict.fromkeys(touched, version + 1)}, buckets, key)
    return version + 1
