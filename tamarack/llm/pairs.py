"""Pairs of the members of two classes, expanded by many tasks however large the classes are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which one block of a class's keys is taken, and pairs of keys from which two blocks get a task of their own.
BLOCK_ROWS, LARGE = 2_048, 10_000


def key_blocks(rows: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """The keys of each class in lists of at most ``BLOCK_ROWS``: one for each stretch of ``rows``, a written table."""
    stretch = F.floor(F.monotonically_increasing_id() / BLOCK_ROWS)
    return rows.withColumn("_stretch", stretch).groupBy(*by, "_stretch").agg(F.collect_list(key).alias(out)).drop("_stretch")


def crossed(both: DataFrame) -> DataFrame:
    """``row_a`` < ``row_b`` of all pairs of a key of ``xs`` and one of ``ys``; pairs of long lists are spread over tasks first."""
    large = F.size("xs") * F.size("ys") > LARGE
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is named isn't merged again
    parts = both.where(~large).unionByName(both.where(large).repartition(tasks, F.xxhash64("xs"), F.xxhash64("ys")))
    out = parts.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    return out.select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
