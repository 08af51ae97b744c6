"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is unset and the master is local (tests on one machine) is a folder chosen
    here; on a cluster that raises ValueError, since a folder of one machine would not be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            base = jvm_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file:///tmp/terselake-checkpoints"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    return path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that ``shared_dir`` gives within the block are deleted at its end.

    Outside of such a block an intermediate stays as long as a DataFrame returned to the caller may
    read it; it belongs to whoever owns ``spark.checkpoint.dir``.
    """
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for path in made:
            remove_path(spark, path)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a folder and read back: cuts lineage, survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a fresh shared folder and read back."""
    return written(df, shared_dir(df.sparkSession, label))


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
