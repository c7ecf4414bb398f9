"""Incremental refresh of the fact store from a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from modweave.runtime import cut
from modweave.sources.files import extract, facts
from modweave.sources.schemas import FACTS, FILES
from modweave.sources.store import FactStore, changed, replaced


def file_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, mtime_ms, content) from Parquet files that arrive in a folder."""
    return spark.readStream.schema(FILES).parquet(folder)


def apply_batch(store: FactStore, batch: DataFrame, config_rows: DataFrame) -> None:
    """Replace the facts of the paths whose newest version in the batch has another time than the stored one."""
    newest = cut(batch.groupBy("path").agg(F.max_by(F.struct("mtime_ms", "content"), "mtime_ms").alias("f")).select("path", "f.*"))
    before = cut(store.read("file_times"))
    touched = cut(changed(newest.select("path", "mtime_ms"), before))
    fresh = cut(newest.join(touched, "path", "left_semi"))
    every = before.select("path").union(newest.select("path")).distinct()
    tables = facts(cut(extract(fresh)), every, config_rows) | {"file_times": fresh.select("path", "mtime_ms")}
    store.save({name: replaced(store.read(name), df, touched, FACTS[name][1]) for name, df in tables.items()})


def start(spark: SparkSession, folder: str, store: FactStore, config_rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; run again for more. A batch that is repeated changes nothing, as its times are stored."""
    return file_versions(spark, folder).writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch, config_rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
