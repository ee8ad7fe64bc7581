"""Resumable batch work as a stream: each new file is processed once, done ids are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id has no result yet; ids are compared as strings."""
    ids = done.select(F.col(key).cast("string").alias("_done")).distinct()
    return rows.join(ids, rows[key].cast("string") == ids["_done"], "left_anti")


def not_standing(rows: DataFrame, done: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows to be done (again): without a result yet, or with one whose file no longer stands in ``files``. Rows without a key are all kept."""
    standing = done.select(F.col(key).cast("string").alias(key)).join(files.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
    return not_done(rows, standing, key)


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, key: str
) -> None:
    """Process all files of ``source`` not processed yet, then stop; results are Parquet, one commit per batch.

    The checkpoint remembers files, the join with earlier results remembers ids,
    so a rerun after a loss repeats nothing that was committed.
    Rows without an id are all kept, as in ``not_done``.
    """

    def batch(rows: DataFrame, number: int) -> None:
        new = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull()))
        try:
            new = not_done(new, spark.read.parquet(results), key)
        except Exception as e:  # noqa: BLE001 - there are no results before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(new).write.mode("append").parquet(results)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
