"""A thin catalog over a dataset's Parquet tables: registration, caching, statistics, sinks."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ddl import parse_ddl

# Storage kinds. All memory kinds are Spark's cache, on or off the heap.
STORAGE = {
    "parquet_file": None,
    "system_memory": StorageLevel.MEMORY_AND_DISK,
    "pinned_memory": StorageLevel.MEMORY_AND_DISK,
    "numa_memory": StorageLevel.MEMORY_AND_DISK,
    "numa_pinned_memory": StorageLevel.MEMORY_AND_DISK,
    "numa_pool_memory": StorageLevel.MEMORY_AND_DISK,
    "device_memory": StorageLevel.MEMORY_ONLY,
    "managed_memory": StorageLevel.MEMORY_AND_DISK,
    "boost_shared_memory": StorageLevel.OFF_HEAP,
}


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, path: str, storage: str = "parquet_file", schema: T.StructType | None = None, view: bool = True) -> DataFrame:
        """A table over a Parquet file or folder; with a schema only its columns, which must be there."""
        if storage not in STORAGE:
            raise ValueError(f"unknown storage {storage!r}; one of {', '.join(STORAGE)}")
        df = self.spark.read.parquet(path)
        if schema is not None:
            if missing := [f.name for f in schema if f.name not in df.columns]:
                raise ValueError(f"unable to find column name {', '.join(missing)} in {name}")
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
        if STORAGE[storage] is not None:
            df = df.persist(STORAGE[storage])
        self.tables[name] = df
        if view:
            df.createOrReplaceTempView(name)
        return df

    def register_dataset(self, folder: str, tables: list[str] | None = None, storage: str = "parquet_file", ddl: str | None = None) -> Catalog:
        """Tables ``<folder>/<table>.parquet`` or ``<folder>/<table>/``, of a DDL text or those named."""
        schemas = parse_ddl(ddl) if ddl else {}
        for name in tables or list(schemas):
            path = self._path(folder, name)
            self.register(name, path, storage, schemas.get(name))
        return self

    def _path(self, folder: str, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        return f"{folder}/{name}.parquet" if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path) else f"{folder}/{name}"

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name}; known: {', '.join(self.tables)}")
        return self.tables[name]

    def table_names(self) -> list[str]:
        return list(self.tables)

    def column_names(self, table: str) -> list[str]:
        return self.table(table).columns

    def unique_columns(self, table: str) -> list[str]:
        return [f.name for f in self.table(table).schema if f.metadata.get("unique")]

    def sql(self, text: str) -> DataFrame:
        """A statement over the registered tables."""
        return self.spark.sql(text)

    def run_file(self, path: str) -> DataFrame:
        """The last statement of a file of SQL, after the ones before it."""
        out = None
        for statement in filter(str.strip, re.sub(r"--[^\n]*", "", Path(path).read_text()).split(";")):
            out = self.sql(statement)
        if out is None:
            raise ValueError(f"no statement in {path}")
        return out

    def statistics(self, table: str) -> DataFrame:
        """A row for each column: rows, nulls, distinct values by sketch, width, least and largest value."""
        df = self.table(table)
        each = [
            F.struct(
                F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(c).isNull().cast("long")).alias("n_nulls"), F.approx_count_distinct(c).alias("n_distinct"),
                F.sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long")).alias("text_bytes"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most"),
            )
            for c in df.columns
        ]
        return df.agg(F.array(*each).alias("s")).select(F.inline("s"))


def write_result(df: DataFrame, path: str, single_file: bool = False, codec: str = "zstd") -> None:
    """A result as Parquet; in a single file only where a reader asks for it."""
    (df.coalesce(1) if single_file else df).write.option("compression", codec).mode("overwrite").parquet(path)


def log_plan(df: DataFrame, path: str) -> str:
    """The formatted physical plan, also written to a file."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
    return text
