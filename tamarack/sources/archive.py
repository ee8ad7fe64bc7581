"""Members of tar archives (plain, gz, bz2, xz) as rows.

The data source streams archives from a file system that all executors mount, one partition per archive;
``members`` reads the bytes of a column, so with ``binaryFile`` it takes archives from any storage Spark reads.
"""

from __future__ import annotations

import glob
import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

AUDIO = (".wav", ".flac", ".mp3", ".ogg", ".m4a", ".webm")


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(p for part in options["path"].split(",") for p in glob.glob(part))
        self.suffixes = tuple(s for s in options.get("suffixes", ",".join(AUDIO)).lower().split(",") if s)

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition) -> Iterator[tuple]:
        with tarfile.open(partition.path, "r|*") as archive:  # streamed, so only one member is held at a time
            for member in archive:
                if member.isfile() and member.name.lower().endswith(self.suffixes):
                    yield partition.path, member.name, member.size, archive.extractfile(member).read()


class TarMembers(DataSource):
    """``spark.read.format("tar_members").load("a.tar.xz,b.tar.xz")``; option ``suffixes`` filters member names."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, size long, content binary"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarMembers)


def members(archives: DataFrame, suffixes: tuple[str, ...] = AUDIO) -> DataFrame:
    """``archive``, ``member``, ``size``, ``content`` of each file in ``archives`` (path, content), as ``binaryFile`` gives them.

    Unreadable and null archives give a row with the ``reason`` and no member. An archive has to fit a row (2 GB).
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = ["archive", "member", "size", "content", "reason"]

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content.as_buffer() if content.is_valid else b""), mode="r:*") as tar:
                        for m in tar:
                            if m.isfile() and m.name.lower().endswith(suffixes):
                                yield row(path, m.name, m.size, tar.extractfile(m).read(), None)
                except (tarfile.TarError, EOFError, OSError) as e:
                    yield row(path, None, None, None, type(e).__name__)

    return archives.select("path", "content").mapInArrow(run, "archive string, member string, size long, content binary, reason string")


def packed(rows: DataFrame, name: str, content: str, most: int = 256) -> DataFrame:
    """Archives (path, content) of at most ``most`` rows each, from a column of member names and one of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part, out = batch.slice(at, most), io.BytesIO()
                with tarfile.open(fileobj=out, mode="w") as tar:
                    for n, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        info = tarfile.TarInfo(n)
                        info.size = len(c)
                        tar.addfile(info, io.BytesIO(c))
                first = part.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([f"{first}.tar"]), pa.array([out.getvalue()], pa.binary())], names=["path", "content"])

    own = rows.where(F.col(name).isNotNull() & F.col(content).isNotNull())
    return own.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, content binary")
