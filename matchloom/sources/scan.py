"""File inventory as a Python data source: folders are split, level by level, into enough partitions."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from matchloom.functions.paths import DATABASES, MEDIA_SUFFIXES, TRASH, has_suffix

SCHEMA = "path string, size long, mtime double, ctime double, error string"


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


#: Folders are opened on the driver, level by level, until there are so many partitions.
PARTS = 256


def _children(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and e.name not in (TRASH, DATABASES))
    except OSError:
        return []


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        """A flat one for every folder that was opened, a deep one for every folder below them."""
        flat, deep = [], deque([self.root])
        while deep and len(flat) + len(deep) < PARTS:
            folder = deep.popleft()
            flat.append(folder)
            deep += _children(folder)
        return [*[_Folder(p, False) for p in flat], *[_Folder(p, True) for p in deep]]

    def read(self, partition):
        for folder, dirs, names in os.walk(partition.path):
            dirs[:] = [d for d in dirs if d not in (TRASH, DATABASES)] if partition.deep else []
            for name in names:
                path = os.path.join(folder, name)
                try:
                    st = os.stat(path)
                    yield path, st.st_size, st.st_mtime, st.st_ctime, None
                except OSError as e:
                    yield path, None, None, None, str(e)


class FileInventory(DataSource):
    """spark.read.format('file_inventory').load(folder): hidden and underscored names too, folder links not followed."""

    @classmethod
    def name(cls):
        return "file_inventory"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(os.path.abspath(self.options["path"]))


def scan_files(spark: SparkSession, folder: str, suffixes: Sequence[str] = MEDIA_SUFFIXES, ordered: bool = False) -> DataFrame:
    """The inventory's rows with these suffixes; ordered: by path (operators here order for themselves)."""
    spark.dataSource.register(FileInventory)
    found = spark.read.format("file_inventory").load(folder).filter(has_suffix(F.col("path"), tuple(suffixes)))
    return found.orderBy("path") if ordered else found
