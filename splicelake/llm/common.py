"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.session import shared_dir

#: ASCII white space and its complement; the same pattern text serves Spark, DuckDB and Python.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """A text with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


_owners: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


@contextmanager
def tables_of(owner: list[str]) -> Iterator[list[str]]:
    """Note the paths of the tables staged inside, by this thread, in ``owner``, who deletes them when their readers are done."""
    before = _owners.set((*_owners.get(), owner))
    try:
        yield owner
    finally:
        _owners.reset(before)


def stage(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the frame that reads it back, and its path.

    The written table survives lost executors and fixes what later steps see. The shuffle files
    behind it have served their purpose then, and Spark removes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/llm/{uuid.uuid4().hex}"
    for owner in _owners.get():
        owner.append(path)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later step reads."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def summed_vectors(rows: DataFrame, given: str, total: str, fans: tuple[int, ...] = (4096, 64)) -> dict[int, np.ndarray]:
    """The sums by key of the vectors in ``rows`` (``k int, v binary`` of type ``given``), in type ``total``.

    Every task gives a vector for each key, so a key's vectors grow with the corpus. They are added in a tree: the
    tasks are dealt to ``fans[0]`` groups, these to ``fans[1]``, and so on, so that no group holds more than a
    thin share. Keys and vectors are few and of fixed size; only the sums reach the driver.
    """

    def add(kind: str):
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            whole = sum(np.frombuffer(v, kind).astype(total) for v in pdf["v"])
            return pd.DataFrame({"k": pdf["k"][:1], "n": pdf["n"][:1], "v": [whole.tobytes()]})

        return fold

    level = rows.withColumn("n", F.spark_partition_id())
    for kind, fan in zip((given, *[total] * len(fans)), (*fans, 1)):
        level = level.withColumn("n", F.pmod("n", F.lit(fan))).groupBy("k", "n").applyInPandas(add(kind), "k int, n int, v binary")
    return {r["k"]: np.frombuffer(r["v"], total) for r in level.collect()}


def short_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python workers in batches of few rows, as one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> Iterator[None]:
    """Batches to Python workers of at most ``rows`` rows and about ``size`` bytes while an action runs inside; the session's own settings come back."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
