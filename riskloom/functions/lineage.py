"""Cutting lineage in loops and before a result is read twice."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOPS_A_CUT = 16  # a walk without a hop limit cuts the union of its hops this often, so its plan stays small


def base_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, shared by the driver and all executors.

    Where it names none, as in tests, a temporary one is set for a local master; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not base:
            base = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, base, True)
        sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used before."""
    return f"{base_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there from now on."""
    base_folder(df.sparkSession)
    return df.checkpoint()


def spread_by(df: DataFrame, *keys: str, bytes_each: int = 8 << 20) -> DataFrame:
    """``df`` dealt by hash of its keys to the session's number of partitions, or more where Catalyst's estimate of its size asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-size // bytes_each)) if size < 1 << 45 else parts, *keys)


def saved(df: DataFrame) -> DataFrame:
    """As ``cut``, for rows as many as pairs: compressed columns, a fraction of a checkpoint's bytes, of which later steps read those they need. How rows were dealt is not remembered."""
    path = new_folder(df.sparkSession, "saved")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(df: DataFrame) -> DataFrame:
    """``df`` for one side of a join by key whose rows grow with the estate: the join sorts and does not broadcast.

    The planner goes by the bytes of compressed files, and takes millions of rows of few columns for small enough to send through the driver.
    """
    return df.hint("merge")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete what this session wrote to a folder below the shared one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a frame that came from ``cut`` and is read no more, which else lie until the session ends."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        drop_folder(df.sparkSession, file.get())
