"""Tables that a run keeps: populations by region, travel times, results by parameters, reports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets one temporary folder; on a cluster that would
    lose data, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-kept-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing is at; a session's are in one folder, by its application id."""
    return f"{shared_folder(spark)}/catchment-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what uses it isn't computed again,
    and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, path: str, **keys: object) -> None:
    """Write ``df`` as parquet, partitioned by ``keys``: a value is one for all rows, None says
    that the column is in ``df``. Only partitions that ``df`` has are replaced."""
    given = {k: F.lit(v) for k, v in keys.items() if v is not None}
    df.withColumns(given).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).parquet(path)


def kept(spark: SparkSession, path: str, **keys: object) -> DataFrame:
    """Rows kept under these keys; the filter prunes partitions. No rows if nothing matches."""
    rows = spark.read.parquet(path)
    for k, v in keys.items():
        rows = rows.where(F.col(k) == F.lit(v))
    return rows.drop(*keys)


class Refreshed(NamedTuple):
    """``rows`` as they are now, and the keys that were ``computed`` for them this time."""

    rows: DataFrame
    computed: DataFrame


def refreshed(spark: SparkSession, path: str, marks: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> Refreshed:
    """Rows kept under ``path`` that follow their inputs: only for keys whose mark is new or has
    changed, ``compute`` (of a table of those keys) is called, and its rows are written as a batch.

    ``marks`` (the columns ``key``, mark: a fingerprint of what the rows of a key come from) says
    which keys there are. A manifest says in which batch each key's rows are; rows of keys that
    are gone or were replaced aren't read, and a batch without a live key is removed. Runs on one
    path must not overlap."""
    marks = marks.select(*key, "mark")
    old, version = None, 1
    try:
        old = spark.read.parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    if old is None:
        stale, now = stored(marks, "stale"), None
    else:
        version = old.agg(F.max("version")).first()[0] + 1
        last = stored(old.where(F.col("version") == version - 1).drop("version"), "manifest")
        stale = stored(marks.join(last, [*key, "mark"], "left_anti"), "stale")
        now = marks.join(last, [*key, "mark"]).select(*key, "mark", "batch")
    if not stale.isEmpty():
        compute(stale.select(*key)).write.mode("overwrite").parquet(f"{path}/rows/batch={version}")
    fresh = stale.withColumn("batch", F.lit(version))
    now = stored(fresh if now is None else now.union(fresh), "manifest")
    now.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")
    live = {r["batch"] for r in now.select("batch").distinct().collect()}  # as many as refreshes
    if old is not None:
        for r in old.where(F.col("version") == version - 1).select("batch").distinct().collect():
            if r["batch"] not in live:
                removed(spark, f"{path}/rows/batch={r['batch']}")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/batch={b}" for b in sorted(live)])
    return Refreshed(rows.join(now.select(*key, "batch"), [*key, "batch"], "left_semi").drop("batch"), stale.select(*key))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear_session(spark: SparkSession) -> None:
    """Delete what ``stored`` has written in this session; no table made from it can be read any more."""
    removed(spark, f"{shared_folder(spark)}/catchment-{spark.sparkContext.applicationId}")


def write_report(results: DataFrame, skipped: DataFrame, path: str) -> None:
    """The two tables of a report: ``Results`` and ``Skipped``."""
    results.write.mode("overwrite").parquet(f"{path}/Results")
    skipped.write.mode("overwrite").parquet(f"{path}/Skipped")
