"""Shared plumbing: reading tables, and cutting lineage through the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")
ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Machines without that folder need the package installed or sent with ``--py-files``.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session (as in tests) gets a folder of its own; a cluster is refused, since a folder of
    one machine would be invisible to the others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The rows survive a lost executor and carry no lineage, unlike cached blocks.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables that this application wrote, once no result that reads them is still to be made."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], T]) -> T:
    """An object that a Python worker keeps between tasks, such as a coder with the words it has met.

    A worker keeps one at a time: that of the operator at work replaces the last one's, which bounds its memory.
    """
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column, nulls as empty texts."""
    return [x or "" for x in column.to_pylist()]
