"""Tails of large files: the last bytes of each, by ranges, without reading what comes before.

`spark.read.format("tail").option("path", ...).option("bytes", 200000).load()` gives (path, line_no, line) of the last bytes of
every file (one path, or several with commas between). Bytes that are not UTF-8 are skipped, also where the first byte falls
within a character; the first line may be cut. Each file is a partition, and a partition seeks to its range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LAST_BYTES = 200_000


class Range(InputPartition):
    def __init__(self, path: str, last: int):
        self.path, self.last = path, last


def opened(path: str):
    """(a seekable file, its size), on whatever store the path names."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner), store.get_file_info(inner).size


class TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options.get("path", "").split(",") if p.strip()]
        self.last = int(options.get("bytes", LAST_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(p, self.last) for p in self.paths]

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        f, size = opened(partition.path)
        with f:
            start = max(0, size - partition.last)
            f.seek(start)
            text = f.read(size - start).decode("utf-8", errors="ignore")
        for i, line in enumerate(text.splitlines()):
            yield partition.path, i, line


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, line_no int, line string"

    def reader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def read_tail(spark: SparkSession, *paths: str, last: int = LAST_BYTES):
    """(path, line_no, line) of the last bytes of each file."""
    spark.dataSource.register(Tail)
    return spark.read.format("tail").option("path", ",".join(paths)).option("bytes", str(last)).load()
