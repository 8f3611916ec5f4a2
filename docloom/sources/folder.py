"""Listing of upload folders as a data source: one row per file, empty and unreadable ones too."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "docloom_folder"
HEAD = 4


class FolderPart(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class FolderReader(DataSourceReader):
    """The folder itself is one partition and every folder in it another, so listings run beside each other."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FolderPart]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=False))
        return [FolderPart(root, False)] + [FolderPart(i.path, True) for i in sorted(infos, key=lambda i: i.path) if i.type == fs.FileType.Directory]

    def read(self, part: FolderPart) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        for info in system.get_file_info(fs.FileSelector(part.folder, recursive=part.deep)):
            if info.type == fs.FileType.Directory:
                continue
            head = None
            try:
                with system.open_input_stream(info.path) as stream:
                    head = stream.read(HEAD)
            except OSError:
                pass  # the verdict of a file that can't be opened is that it can't
            changed = info.mtime or datetime.fromtimestamp(0, timezone.utc)
            yield info.path, changed, int(info.size or 0), head


class FolderSource(DataSource):
    """spark.read.format("docloom_folder").load(path): path, modificationTime, length, head (first bytes; null if unreadable)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint, head binary"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
