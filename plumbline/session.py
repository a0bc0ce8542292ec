"""Sessions and their settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What any size of cluster wants; sizes of partitions are left to the runtime plan.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def session(app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
