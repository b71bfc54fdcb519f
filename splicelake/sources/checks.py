"""First-line checks of downloaded files, and small readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.schemas import stored_schema
from splicelake.sources.first_lines import first_lines
from splicelake.sources.quoted_csv import read_quoted_csv

#: Stored tables whose rows belong to no single species.
ALL_SPECIES = ("domain_type", "orthology", "representative_domains")


def sniff_headers(spark: SparkSession, path: str, prefixes: Sequence[str]) -> DataFrame:
    """(file, first_line, is_valid) of every file under ``path``; of each only the blocks of its first line are read."""
    first = first_lines(spark, path).select("file", F.ltrim("first_line").alias("first_line"))
    return with_validity(first, "first_line", prefixes)


def with_validity(df: DataFrame, line: str, prefixes: Sequence[str]) -> DataFrame:
    """Flag lines that begin with an accepted header; ``<`` marks a saved error page."""
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | F.col(line).startswith(p)
    return df.withColumn("is_error_page", F.col(line).startswith("<")).withColumn("is_valid", ok & ~F.col(line).startswith("<"))


def load_table(spark: SparkSession, folder: str, name: str, species: str | None = None) -> DataFrame:
    """A stored table, or one species of it; ``specie`` is a column of every table but those of all species."""
    schema = stored_schema(name)
    if name not in ALL_SPECIES and "specie" not in schema.names:
        schema = schema.add("specie", "string")
    df = spark.read.schema(schema).parquet(f"{folder}/{name}")
    if species is not None and "specie" not in df.columns:
        raise ValueError(f"{name} is one table for all species")
    return df if species is None else df.filter(F.col("specie") == species)


def read_result_csv(spark: SparkSession, path: str, schema: str | None = None, stray_quotes: bool = False) -> DataFrame:
    """Quoted CSV with embedded commas, doubled quotes and line breaks; large files are read in splits.

    Where quotes stand inside unquoted fields (``stray_quotes``) no split can be read by itself, and a file is one task.
    """
    if not stray_quotes:
        return read_quoted_csv(spark, path, schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def cluster_counts(results: DataFrame, cluster: str = "cluster") -> DataFrame:
    return results.agg(F.count("*").alias("n_rows"), F.countDistinct(cluster).alias("n_clusters"))


def preview(results: DataFrame, rows: int = 500) -> DataFrame:
    """The first rows by all columns, the same on every run."""
    return results.orderBy(*results.columns).limit(rows)
