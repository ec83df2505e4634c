"""A folder connector as a PySpark data source: the listing is planned on the driver, files are fetched by tasks.

``spark.read.format("folder").option("path", ...)`` gives name, extension, n_bytes, status, content; a file that cannot be
fetched is a row with status "error" and never ends the import.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioscope.sources.files import SUPPORTED

FILES_PER_PARTITION = 32


class Names(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)


class FolderReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else os.path.abspath(self.path))

    def partitions(self) -> list[InputPartition]:
        system, root = self.place()
        names = sorted(x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File)
        return [Names(names[i : i + FILES_PER_PARTITION]) for i in range(0, len(names), FILES_PER_PARTITION)]

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        system, _ = self.place()
        for name in partition.value if partition else ():
            kind = name.rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""
            if kind not in SUPPORTED:
                yield name, kind, None, "skipped", None
                continue
            try:
                with system.open_input_stream(name) as f:
                    content = f.read()
                yield name, kind, len(content), "queued", content
            except OSError:
                yield name, kind, None, "error", None


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "name string, extension string, n_bytes long, status string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"])


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(path)


def receipt(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count("*").alias("files"))
