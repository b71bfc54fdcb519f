"""First lines of many files, read block by block and no further than the line's end."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.sources.lines import line_order

#: Bytes asked for at a time; a file costs one such block unless its first line is longer.
BLOCK = 1 << 16
#: File systems that pyarrow opens by itself; files on others go through Spark's text source.
_OPENED = ("file", "hdfs", "s3", "gs")


def _ends(block: bytes) -> int:
    """Where the line ends in ``block``, or -1."""
    found = [at for at in (block.find(b"\n"), block.find(b"\r")) if at >= 0]
    return min(found, default=-1)


def open_uri(uri: str):
    """pyarrow's file system of a URI, and the path in it; the JVM leaves letters beyond ASCII unescaped."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("".join(c if ord(c) < 128 else quote(c) for c in uri))


def read_first_line(uri: str, block: int = BLOCK) -> tuple[str | None, int]:
    """The first line of a file, null for an empty file, and the bytes that were read from it."""
    system, path = open_uri(uri)
    with system.open_input_file(path) as file:
        source = gzip.GzipFile(fileobj=file) if path.endswith(".gz") else file
        line = bytearray()
        while got := source.read(block):
            at = _ends(got)
            line += got if at < 0 else got[:at]
            if at >= 0:
                return bytes(line).decode("utf-8", "replace"), file.tell()
        return (bytes(line).decode("utf-8", "replace") if line else None), file.tell()


def _file_system(spark: SparkSession, path: str):
    """``path`` for the JVM and the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def opened_uri(spark: SparkSession, path: str) -> str | None:
    """``path`` in full, as tasks open it by pyarrow; null where pyarrow doesn't know the file system."""
    at, system = _file_system(spark, path)
    return system.makeQualified(at).toUri().toString() if system.getScheme() in _OPENED else None


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _escaped(path: str) -> str:
    """``path`` inside a URI, escaped as the JVM does."""
    return "".join(c if ord(c) > 127 or c.isalnum() or c in "/_-.~!*'();:@&=+$," else f"%{ord(c):02X}" for c in path)


def _below(uri: str, recursive: bool) -> Iterator[tuple[str, bool]]:
    """The URIs of what a folder holds, and whether each is a folder; a file is given back as it is."""
    from pyarrow import fs

    system, base = open_uri(uri)
    if system.get_file_info(base).type == fs.FileType.File:
        yield uri, False
        return
    for found in system.get_file_info(fs.FileSelector(base, recursive=False)):
        at = f"{uri.rstrip('/')}/{_escaped(found.base_name)}"
        folder = found.type == fs.FileType.Directory
        if _hidden(found.base_name):
            continue
        if folder and recursive:
            yield from _below(at, True)
        else:
            yield at, folder


def _listed(recursive: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for b in batches for uri in b.column(0).to_pylist() for row in _below(uri, recursive))
        while rows := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["file", "is_folder"]
            )

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The URI of every file that Spark's readers would read from ``path``: its own files, and all in folders named ``key=value``.

    The folders at the top are listed by one task, each of them is listed by another, so that no file's name
    passes the driver.
    """
    at, system = _file_system(spark, path)
    # Files are named as in Spark's metadata, with file:/a for file:///a.
    roots = [(s.getPath().toUri().toString().replace("file:///", "file:/", 1),) for s in system.globStatus(at) or []]
    if not roots:
        spark.read.text(path)  # says what is missing as every reader does
    tasks = 4 * spark.sparkContext.defaultParallelism
    tops = spark.createDataFrame(roots, "file string").mapInArrow(_listed(False), "file string, is_folder boolean")
    kept = tops.filter(~F.col("is_folder") | F.element_at(F.split("file", "/"), -1).contains("=")).select("file")
    return kept.repartition(tasks).mapInArrow(_listed(True), "file string, is_folder boolean").select("file").repartition(tasks)


def first_lines(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """``file, first_line, bytes_read`` of every file under ``path`` that has a line.

    Tasks list the folders, and the files are dealt to tasks by their number; a task opens each and stops at the first line
    end (line feed or carriage return), however long the line is. Files ending in ``.gz`` are unpacked. Where
    pyarrow can't open the file system, whole files are scanned by Spark's text source and ``bytes_read`` is null.
    """
    if opened_uri(spark, path) is None:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), line_order().alias("_row"), "value"
        )
        first = lines.filter("_at = 0").groupBy("file").agg(F.min_by("value", "_row").alias("first_line"))
        return first.withColumn("bytes_read", F.lit(None).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = [read_first_line(n, block) for n in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())],
                names=["file", "first_line", "bytes_read"],
            )

    return _files(spark, path).mapInArrow(read, "file string, first_line string, bytes_read long").filter("first_line IS NOT NULL")
