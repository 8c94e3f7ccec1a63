"""Parquet footers as a table, read in tasks: rows, bytes, least, largest and null values of each column of each row group.

The files are named by Spark; tasks open their footers through pyarrow, so they have to lie in a file system that pyarrow knows by its URI (local or
mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, row_group int, row_group_rows long, row_group_bytes long, column string, kind string, low string, high string, nulls long, n long, bytes long"
#: Footers read by a task.
FILES = 64


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> Sequence[InputPartition]:
        return [_Files(self.files[i : i + FILES]) for i in range(0, len(self.files), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for name in partition.files:
            system, path = pafs.FileSystem.from_uri(name) if "://" in name or name.startswith("file:") else (pafs.LocalFileSystem(), name)
            with system.open_input_file(path) as held:
                footer = pq.ParquetFile(held).metadata
            for g in range(footer.num_row_groups):
                group = footer.row_group(g)
                for c in range(group.num_columns):
                    column = group.column(c)
                    s = column.statistics
                    known = s is not None and s.has_min_max
                    nulls = s.null_count if s is not None and s.has_null_count else None
                    yield (name, g, group.num_rows, group.total_byte_size, column.path_in_schema, column.physical_type, str(s.min) if known else None, str(s.max) if known else None, nulls, column.num_values, column.total_compressed_size)


class ParquetFooters(DataSource):
    """The format ``parquet_footers``; the option ``files`` is a JSON list of paths."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]))


def footer_statistics(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row for each column of each row group of the files; values are texts, null where the footer has none."""
    spark.dataSource.register(ParquetFooters)
    plain = [f.replace("file:///", "/") if f.startswith("file:///") else f for f in files]
    return spark.read.format("parquet_footers").option("files", json.dumps(plain)).load()


def footer_totals(stats: DataFrame) -> DataFrame:
    """Rows, bytes and row groups of each file, before anything of it is read."""
    groups = stats.select("file", "row_group", "row_group_rows", "row_group_bytes").distinct()
    return groups.groupBy("file").agg(F.sum("row_group_rows").alias("rows"), F.sum("row_group_bytes").alias("bytes"), F.count("*").alias("row_groups"))
