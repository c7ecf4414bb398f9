"""Fact tables kept as Parquet by path: look-up, replacement, change detection, JSON lines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from modweave.sources.schemas import FACTS


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, state) of files (path, mtime_ms) to read again: ``new``, or ``changed`` if the times differ either way."""
    b = before.select("path", F.col("mtime_ms").alias("_before"))
    state = F.when(F.col("_before").isNull(), "new").when(F.col("_before") != F.col("mtime_ms"), "changed")
    return now.join(b, "path", "left").withColumn("state", state).filter("state IS NOT NULL").select("path", "state")


def vanished(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths that are gone."""
    return before.join(now, "path", "left_anti").select("path")


def replaced(old: DataFrame, new: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of the touched paths, and ``new``: all facts of a path change together."""
    return old.join(touched.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


class FactStore:
    """The fact tables of :data:`FACTS` in a folder; each version is written whole and then named current."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> str | None:
        """Name of the current version, or none."""
        fs, path = self._files()
        marks = path(f"{self.folder}/current")
        if not fs.exists(marks):
            return None
        return max((s.getPath().getName() for s in fs.listStatus(marks)), default=None)

    def read(self, name: str) -> DataFrame:
        """A fact table; empty before the first save."""
        version, (schema, _) = self.version(), FACTS[name]
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{version.split('-', 1)[1]}/{name}")

    def lookup(self, name: str, condition: Column) -> DataFrame:
        return self.read(name).filter(condition)

    def save(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables as a new version; readers see it once all are there."""
        fs, path = self._files()
        old = self.version()
        count, tag = (int(old.split("-", 1)[0]) + 1 if old else 0), uuid.uuid4().hex
        for name, (_, key) in FACTS.items():
            df = tables[name] if name in tables else self.read(name)
            df.sortWithinPartitions(key).write.parquet(f"{self.folder}/{tag}/{name}")
        fs.create(path(f"{self.folder}/current/{count:09d}-{tag}")).close()

    def refresh(self, files: DataFrame, extract) -> DataFrame:
        """Read changed files again, drop vanished ones, and save. Returns the touched paths and states.

        ``files`` has path, mtime_ms and content; ``extract`` maps such rows to fact tables by name.
        """
        from modweave.runtime import cut

        before = self.read("file_times")
        now = files.select("path", "mtime_ms")
        touched = cut(changed(now, before).unionByName(vanished(now, before).withColumn("state", F.lit("gone"))))
        fresh = files.join(touched.filter("state <> 'gone'"), "path", "left_semi")
        tables = extract(fresh) | {"file_times": fresh.select("path", "mtime_ms")}
        self.save({name: replaced(self.read(name), df, touched, FACTS[name][1]) for name, df in tables.items()})
        return touched


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Facts from JSON lines; an empty file gives no rows."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has (with repeats), and which; columns must be the same."""
    if sorted(left.dtypes) != sorted(right.dtypes):
        raise ValueError(f"columns differ: {left.dtypes} and {right.dtypes}")
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def first_difference(a: object, b: object, at: str = "") -> str | None:
    """Where two nested values differ, or none; for maps, lists, strings, numbers, booleans and null."""
    if isinstance(a, dict) and isinstance(b, dict):
        for key in sorted(a.keys() | b.keys(), key=str):
            if key not in a or key not in b:
                return f"{at}/{key}: only on the {'right' if key not in a else 'left'}"
            if found := first_difference(a[key], b[key], f"{at}/{key}"):
                return found
        return None
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            return f"{at}: {len(a)} and {len(b)} items"
        return next((x for i, (p, q) in enumerate(zip(a, b, strict=True)) if (x := first_difference(p, q, f"{at}/{i}"))), None)
    for x in (a, b):
        if x is not None and not isinstance(x, (dict, list, str, int, float, bool)):
            raise TypeError(f"{at}: cannot compare {type(x).__name__}")
    return None if type(a) is type(b) and a == b else f"{at}: {a!r} and {b!r}"


def repository_root(path: str) -> str:
    """The closest folder at or above ``path`` that holds ``.git``."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            raise FileNotFoundError(f"no repository holds {path}")
        at = os.path.dirname(at)
    return at
