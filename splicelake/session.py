"""Session helpers: the shared folder, lineage cuts and table storage."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A session that names none gets a folder below its warehouse. On a cluster that must not be a folder
    of the driver's own machine: every executor would write to its own disk, and rows would be missed.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if urlsplit(folder).scheme in ("", "file") and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor never loses the rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_inside: Counter[str] = Counter()
_before: dict[str, str | None] = {}
_COUNTING = Lock()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action run inside are removed when it has ended.

    For writes: what was written is read back, so nothing needs the shuffles behind it again. Threads may be inside together;
    the last to leave puts the session's own setting back.
    """
    app = spark.sparkContext.applicationId
    with _COUNTING:
        if not _inside[app]:
            _before[app] = spark.conf.get(_CLEAN_UP, None)
            spark.conf.set(_CLEAN_UP, "true")
        _inside[app] += 1
    try:
        yield
    finally:
        with _COUNTING:
            _inside[app] -= 1
            if not _inside[app]:
                before = _before.pop(app)
                spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside are deleted at the end, but for those staged with ``kept=True``.

    Nothing that lives on may read them: what is handed out has to be written (``kept``) or stored by then.
    """
    mine: list[str] = []
    before = _scratch.set((*_scratch.get(), mine))
    try:
        yield
    finally:
        _scratch.reset(before)
        _delete(spark, mine)


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a staged table; ``df`` is what ``staged`` returned, and no frame that is still to be read may need it."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    _delete(df.sparkSession, (f for f in folders if "/staged/" in f))


def staged(df: DataFrame, by: str | None = None, kept: bool = False) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    For results that several branches of a plan need: they scan the columns they
    use instead of computing everything again, and the files outlive executors. With ``by``, a text
    column, rows of one value can be read without the others. The shuffles behind it are dropped. ``kept`` leaves the
    table out of the innermost ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/staged/{uuid.uuid4().hex}"
    owners = _scratch.get()
    for owner in owners[: len(owners) - kept]:
        owner.append(path)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    with shuffles_dropped(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_for_good(df: DataFrame) -> DataFrame:
    """``staged`` with ``kept=True``: what a ``scratch`` hands out."""
    return staged(df, kept=True)
