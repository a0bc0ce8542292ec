"""Timed runs, their records as Parquet tables, and the analysis of them."""

from __future__ import annotations

import json
import threading
import time
import traceback
import uuid
from collections.abc import Callable
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import best_per_group, warm_statistics
from ..sources.catalog import STORAGE
from .config import SweepConfig, combinations, spark_conf

RUN = "query string, parameters string, number int, duration_s double, error string"


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """Settings for a while; what was set before comes back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def timed(df: DataFrame) -> float:
    """Seconds of a full run that writes nowhere."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@contextmanager
def stopped_after(spark: SparkSession, seconds: float):
    """Jobs that this thread starts meanwhile are cancelled after so long; the yielded list then holds a mark."""
    sc, group, late = spark.sparkContext, f"run-{uuid.uuid4().hex}", []

    def stop() -> None:
        late.append(True)
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    sc.setJobGroup(group, "timed run", True)
    timer.start()
    try:
        yield late
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


@contextmanager
def stored(spark: SparkSession, folder: str, storage: str):
    """The dataset's tables held in a kind of storage; queries that read them from Parquet then find them in the cache."""
    held = []
    try:
        if STORAGE[storage] is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
                if status.getPath().getName().endswith(".parquet"):
                    held.append(spark.read.parquet(f"{folder}/{status.getPath().getName()}").persist(STORAGE[storage]))
                    held[-1].count()
        yield
    finally:
        for df in held:
            df.unpersist(blocking=True)


def run_once(spark: SparkSession, query: Callable, dataset: str, timeout: float, check: Callable[[DataFrame], str] | None = None) -> tuple[float | None, str | None]:
    """Seconds and fault of one run; one of them is null. A run beyond the timeout is cancelled and is a fault."""
    late: list = []
    try:
        with stopped_after(spark, timeout) as late:
            df = query(spark, dataset)
            seconds = timed(df)
            if check and (fault := check(df)):
                return seconds, fault
        return seconds, None
    except Exception:
        return None, f"timeout of {timeout} s" if late else traceback.format_exc()[-500:]


def sweep(spark: SparkSession, config: SweepConfig, queries: dict[str, Callable], check: Callable[[str, DataFrame], str] | None = None, records: str | None = None) -> DataFrame:
    """A row for each run, failed ones too. Run 0 of each combination is the warm-up; a result that ``check`` faults fails.

    With ``records``, a folder, each combination's rows are appended when it is done, and combinations that are there already aren't
    run again. A load beyond its timeout fails all combinations of its storage.
    """
    rows = [(name, row) for name in config.queries for row in combinations(config, name)]
    done = {(r.query, r.parameters) for r in recorded(spark, records).select("query", "parameters").distinct().collect()} if records else set()
    todo = [(name, row) for name, row in rows if (name, json.dumps(row, sort_keys=True)) not in done]
    found = []

    def add(new: list[tuple]) -> None:
        found.extend(new)
        if records:
            spark.createDataFrame(new, RUN).coalesce(1).write.mode("append").parquet(records)

    for storage in dict.fromkeys(row["storage"] for _, row in todo):
        some = [(name, row) for name, row in todo if row["storage"] == storage]
        late: list = []
        try:
            with ExitStack() as stack:
                with stopped_after(spark, config.load_timeout) as late:
                    stack.enter_context(stored(spark, config.dataset, storage))
                for name, row in some:
                    add(_runs(spark, config, queries[name], name, row, check))
        except Exception:
            if not late:
                raise
            add([(name, json.dumps(row, sort_keys=True), 0, None, f"load timeout of {config.load_timeout} s") for name, row in some])
    return recorded(spark, records) if records else spark.createDataFrame(found, RUN)


def _runs(spark: SparkSession, config: SweepConfig, query: Callable, name: str, row: dict, check) -> list[tuple]:
    """The runs of a combination, up to the first fault."""
    found = []
    with settings(spark, spark_conf(row)):
        for number in range(config.repeat):
            own = (lambda df: check(name, df)) if check and config.validate and not number else None
            seconds, error = run_once(spark, query, config.dataset, config.query_timeout, own)
            found.append((name, json.dumps(row, sort_keys=True), number, seconds, error))
            if error:
                break
    return found


def recorded(spark: SparkSession, records: str) -> DataFrame:
    """The rows of a folder of records; none if nothing is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(records)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(RUN).parquet(records) if there else spark.createDataFrame([], RUN)


def run_best(spark: SparkSession, config: SweepConfig, queries: dict[str, Callable], runs: DataFrame) -> DataFrame:
    """Each query again, in the configuration that earlier runs show to be its best."""
    found = []
    for r in best(runs).select("query", "parameters").collect():  # a row a query
        if r.query in config.queries:
            row = json.loads(r.parameters)
            with stored(spark, config.dataset, row["storage"]):
                found += _runs(spark, config, queries[r.query], r.query, row, None)
    return spark.createDataFrame(found, RUN)


def statistics(runs: DataFrame) -> DataFrame:
    """Mean, extremes and count of each configuration's good runs, without the warm-up."""
    return warm_statistics(runs.where("error IS NULL"), ["query", "parameters"], "number", "duration_s")


def best(runs: DataFrame) -> DataFrame:
    """The configuration of each query with the least mean duration."""
    return best_per_group(statistics(runs), ["query"], "mean", ["parameters"])


def flaky(runs: DataFrame, asked: int) -> DataFrame:
    """Configurations with fewer good runs than were asked for."""
    return statistics(runs).where(F.col("n") < asked - 1)


def failed(runs: DataFrame) -> DataFrame:
    """Configurations without a good run."""
    keys = ["query", "parameters"]
    return runs.select(*keys).distinct().join(runs.where("error IS NULL").select(*keys).distinct(), keys, "left_anti")
