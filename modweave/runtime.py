"""Session helpers shared by all operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


_kept: list[dict] = []


def kept() -> dict:
    """A dictionary that a Python worker keeps between the tasks of its operator; other operators' tasks empty it."""
    _kept.append({})
    return _kept[-1]


def give_back(own: dict | None = None) -> None:
    """Return the memory that a Python worker has freed to the system; of what is ``kept``, only ``own`` stays.

    Workers outlive their tasks and rest beside those of the next operator, and the allocators
    hold on to what was freed. Only glibc can be asked for it; elsewhere Arrow's part is returned.
    """
    for cache in _kept:
        if cache is not own:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names; only where all runs on one machine, as in tests, a local one."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="modweave-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: smaller than a checkpoint where rows hold texts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str = "n", least: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row for each key, whose ``count`` (dropped) tells how many rows have the key.

    Keys of over a thousandth of all rows are at most a thousand: they meet their rows by broadcast,
    the others by a shuffle. Both inputs are read more than once.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    common = F.col(count) > max(least, total // 1000)
    hot, rare = F.broadcast(table.filter(common).drop(count)), table.filter(~common).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rare, key))
