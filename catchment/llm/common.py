"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would lose data, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing is at; a session's are in one folder, by its application id."""
    return f"{shared_dir(spark)}/catchment-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts that go to Python at once: 10,000, the usual number, would be tens of MB, which
#: JVM and worker both hold several times.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session have BATCH_ROWS rows at most, if they may have more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def bytes_held(df: DataFrame) -> int:
    """About the bytes of all rows of ``df``, a stored table, in memory."""
    width = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
        elif kind.startswith(("array", "struct", "map")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{name}`"))), F.lit(0))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most_mb: int = 16) -> DataFrame:
    """``df``, a stored table, with a broadcast hint if its rows take up ``most_mb`` at most,
    else as it is: the join then shuffles."""
    return F.broadcast(df) if bytes_held(df) <= most_mb << 20 else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
