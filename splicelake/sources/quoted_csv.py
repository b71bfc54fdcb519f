"""Quoted CSV with line breaks in fields, read by many tasks a file."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicelake.session import staged

_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split, row in the split; quotes before the line in its split, and in it."""
    text = spark.read.option("lineSep", "\n").text(path)
    parts = [c for c in text.columns if c != "value"]
    return text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))).alias("_quotes"),
        "value",
        *parts,
    )


def _records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``_file, _from, _n`` (split it starts in, order there), ``value`` and partition columns.

    A line starts a record where an even number of quotes lies before it in the file. Within a split that number is
    known but for its parity at the split's start, so both cases are counted, and the parities
    of the splits are summed over one row per split. A record on one line is whole; only
    records over several lines are gathered, each by itself.
    """
    every = _numbered_lines(spark, path)
    parts = [c for c in every.columns if not c.startswith("_") and c != "value"]
    # Only a line with an odd number of quotes can begin or end inside a field: in files without one each line is a record.
    broken_files = staged(every.filter("_quotes % 2 = 1").select("_file").distinct())
    plain = every
    if broken_files.limit(1).count():
        plain, raw = every.join(broken_files, "_file", "left_anti"), every.join(broken_files, "_file", "left_semi")
    single = plain.select("_file", F.col("_block").alias("_from"), F.col("_row").alias("_n"), "value", *parts)
    records = single if plain is every else single.unionByName(_gathered(raw, parts))
    return records.withColumn("value", F.regexp_replace("value", r"\r$", "")).filter("value <> ''")


def _gathered(raw: DataFrame, parts: list[str]) -> DataFrame:
    """The records of files in which some go over several lines."""
    so_far = Window.partitionBy("_file", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    counted = raw.withColumn("_through", F.sum("_quotes").over(so_far)).withColumn("_odd", (F.col("_through") - F.col("_quotes")) % 2)
    even = F.count_if(F.col("_odd") == 0).over(so_far)
    lines = staged(counted.withColumn("_if_even", even).withColumn("_if_odd", F.count("*").over(so_far) - even))

    splits = lines.groupBy("_file", "_block").agg(
        (F.sum("_quotes") % 2).alias("_parity"), F.max("_if_even").alias("_even"), F.max("_if_odd").alias("_odds")
    )
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_open", F.coalesce(F.sum("_parity").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("_starts", F.when(F.col("_open") == 0, F.col("_even")).otherwise(F.col("_odds")))
    started = F.when(F.col("_starts") > 0, F.struct(F.col("_block").alias("block"), F.col("_starts").alias("n")))
    splits = splits.withColumn("_last", F.last(started, ignorenulls=True).over(before)).select("_file", "_block", "_open", "_last")

    placed = lines.join(splits, ["_file", "_block"])
    here = F.when(F.col("_open") == 0, F.col("_if_even")).otherwise(F.col("_if_odd"))
    placed = placed.select(
        "_file",
        F.when(here > 0, F.col("_block")).otherwise(F.col("_last.block")).alias("_from"),
        F.when(here > 0, here).otherwise(F.col("_last.n")).alias("_n"),
        ((F.col("_odd") == F.col("_open")) & (F.col("_quotes") % 2 == 0)).alias("_whole"),
        "_block",
        "_row",
        "value",
        *parts,
    )
    whole = placed.filter("_whole").select("_file", "_from", "_n", "value", *parts)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_row", "value"))), lambda p: p["value"])
    broken = (
        placed.filter("NOT _whole")
        .groupBy("_file", "_from", "_n")
        .agg(F.array_join(pieces, "\n").alias("value"), *[F.first(p).alias(p) for p in parts])
    )
    return whole.unionByName(broken.select("_file", "_from", "_n", "value", *parts))


def _names(header: str) -> list[str]:
    """Column names of a header record: empty ones by position, repeated ones with their position behind."""
    given = next(csv.reader([header]))
    lower = [g.lower() for g in given]
    return [f"_c{k}" if not g else f"{g}{k}" if lower.count(g.lower()) > 1 else g for k, g in enumerate(given)]


def read_quoted_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Files with a header record each; equal to the ``multiLine`` reader, but a file is read by as many tasks as it has splits.

    Quotes must be used as quoting only: a field that holds a quote is quoted and its quotes are doubled. Without a schema the names are
    those of the first file and all columns text. Empty records are skipped; carriage returns before
    a record's line feed belong to the line end. An empty folder without a schema has no columns to name and is an error.
    """
    records = staged(_records(spark, path))
    header = records.groupBy("_file").agg(F.min(F.struct("_from", "_n", "value")).alias("_head"))
    if schema is None:
        first = header.orderBy("_file").first()
        if first is None:
            raise ValueError(f"no header below {path}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(first["_head"]["value"])])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # As in Spark's own readers, a column that the folders name is no column of the files.
    kinds = {f.name: f.dataType for f in schema.fields}
    found = [c for c in records.columns if c not in ("_file", "_from", "_n", "value")]
    parts = [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in found]
    schema = T.StructType([f for f in schema.fields if f.name not in found])
    at: Column = F.struct("_from", "_n")
    places = header.select("_file", F.struct("_head._from", "_head._n").alias("_head"))
    body = records.join(F.broadcast(places), "_file").filter(at > F.col("_head"))
    return body.select(F.from_csv("value", _ddl(schema), _OPTIONS).alias("_r"), *parts).select("_r.*", *found)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
