"""Written stages, size-checked broadcasts and small plan helpers.

A stage is a table written below ``spark.checkpoint.dir``: it survives the loss
of an executor, cuts the lineage and lets several consumers share one pass.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []

#: Rows up to which a table whose size nothing else bounds may be broadcast.
BROADCAST_ROWS = 20_000


def stage_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "tamarack-stages")
        atexit.register(shutil.rmtree, f"{root}/tamarack-{spark.sparkContext.applicationId}", ignore_errors=True)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own among this application's stages."""
    path = f"{stage_root(spark)}/tamarack-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """A stage and its number of rows, counted while it is written."""
    seen = Observation()
    return stage(df.observe(seen, F.count(F.lit(1)).alias("n")), label), seen.get["n"]


def release(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more deleted now, not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete this application's stages; call it when no result that reads them is needed any more."""
    _delete(spark, f"{stage_root(spark)}/tamarack-{spark.sparkContext.applicationId}")
    _made.clear()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Delete the stages made inside once it is left; write or collect results inside, since they read their stages."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            _delete(spark, path)
        del _made[before:]


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, found without counting beyond them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the size was checked; otherwise the planner shuffles."""
    return F.broadcast(df) if small(df, max_rows) else df


def fresh(base: str, taken) -> str:
    """A column name that no column in ``taken`` has, whatever its letter case."""
    low = {c.lower() for c in taken}
    name = base
    while name.lower() in low:
        name = "_" + name
    return name


def with_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join by keys that may be null; the keys are those of the left side."""
    other = {k: fresh(f"other_{k}", [*left.columns, *right.columns]) for k in keys}
    right = right.withColumnsRenamed(other)
    cond = F.lit(True)
    for k, o in other.items():
        cond = cond & F.col(k).eqNullSafe(F.col(o))
    return left.join(right, cond, how).drop(*other.values())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
