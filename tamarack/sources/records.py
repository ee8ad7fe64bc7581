"""Record sources and sinks: JSONL (strict and tolerant), CSV with byte-order mark, atomic single files."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ManifestError

#: Characters of a bad line that its report shows.
PREVIEW = 300


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as ``value``."""
    return spark.read.text(path).where("trim(value) <> ''")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict: the first line that is no JSON object of the schema aborts the load."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines): malformed lines are kept apart with the start of their text."""
    bad = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = read_lines(spark, path).select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"), "value")
    wrong = F.col(f"r.{bad}").isNotNull() | F.col("r").isNull()
    good = rows.where(~wrong).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    lines = rows.where(wrong).select(F.lit("malformed JSON").alias("error"), F.substring("value", 1, PREVIEW).alias("preview"))
    return good, lines


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip('"') if i == 0 else c for i, c in enumerate(df.columns)])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Manifest by suffix; other suffixes are an error."""
    kind = Path(path).suffix.lower()
    if kind in (".jsonl", ".ndjson", ".json"):
        return spark.read.option("mode", "FAILFAST").json(path) if schema is None else read_jsonl(spark, path, schema)
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ManifestError(f"unsupported manifest suffix: {kind or path}")


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a Parquet table; an error if it is missing."""
    df = spark.read.parquet(path)
    if column not in df.columns:
        raise ManifestError(f"no column {column} in {path}")
    return df.select(column)


def column_choice(df: DataFrame, names: list[str]) -> str:
    """The first of the names that is a column at all, whatever its values."""
    for n in names:
        if n in df.columns:
            return n
    raise ManifestError(f"none of the columns {', '.join(names)}")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace a JSONL table; Spark's commit protocol makes it visible only when complete. Keys are sorted."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("append").option("ignoreNullFields", False).json(path)


def write_json_file(path: str | os.PathLike, value) -> None:
    """Replace a small JSON file at once: written beside it, flushed to disk, then renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, prefix=target.name, delete=False) as f:
        json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with header, moved into place when complete.

    For reports and submissions that have to be one file; the rows stream through
    one writer task and are never gathered in the driver.
    """
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.coalesce(1).write.options(**exact).csv(part.toString())
    fs = target.getFileSystem(conf)
    made = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(part, "part-*"))]
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = df.sparkSession.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE  # in one step where the file system has one, so the old file stays until the new one stands
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(made[0], fs.makeQualified(target), how)
    fs.delete(part, True)


def write_variants(df: DataFrame, path: str) -> None:
    """Submission variants as one table partitioned by ``variant``."""
    df.write.mode("overwrite").partitionBy("variant").option("header", True).csv(path)


def cached_files(spark: SparkSession, folder: str, fetch) -> list[str]:
    """Parquet files of a folder; ``fetch(folder)`` is called only if there is none yet."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())

    def found() -> list[str]:
        return sorted(s.getPath().toString() for s in (fs.globStatus(pattern) or []))

    if not found():
        fetch(folder)
    return found()
