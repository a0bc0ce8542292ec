"""What the training-data operators share: table access, scratch tables, stable hashes."""

from __future__ import annotations

import uuid
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables and files of one job, in the folder that the cluster shares."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/plumbline-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write a table and read it back, which cuts its lineage."""
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more (all of them without a name)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names; extra columns of the input can't clash with ours."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def held_out(doc_id="doc_id"):
    """Rows of the fifth fold, whose labels are never learnt from."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: each input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rows:
    """Rows of numbers of two kinds and any length, one after the other in two growing arrays: a driver that trains holds no more than
    these, and gives all of it back."""

    def __init__(self, first: str = "i", second: str = "f"):
        self.first, self.second, self.edges = array(first), array(second), [0]

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first.frombytes(first.astype(self.first.typecode).tobytes())
        self.second.frombytes(second.astype(self.second.typecode).tobytes())
        self.edges.append(len(self.first))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.edges[i], self.edges[i + 1])
        return np.frombuffer(self.first, self.first.typecode)[part], np.frombuffer(self.second, self.second.typecode)[part]


def parts(texts: list, most: int = 1 << 21):
    """The list in runs of about ``most`` characters, a text never cut; bounds what a step holds at once."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]
