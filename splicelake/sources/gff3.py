"""GFF3 features with an attribute map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.sources.lines import line_order

GFF_SCHEMA = (
    "seqid STRING, source STRING, type STRING, start BIGINT, end BIGINT, score STRING, strand STRING, "
    "phase STRING, attributes STRING"
)


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature line: the nine columns, ``attrs`` (percent-decoded later, per use) and ``ord``.

    'First' and 'last' in the readers built on this follow ``ord``, the order of lines.
    """
    raw = (
        spark.read.schema(GFF_SCHEMA)
        .option("sep", "\t")
        .option("comment", "#")
        .option("quote", "\u0000")
        .csv(path)
        .select(
            "*",
            line_order().alias("ord"),
        )
    )
    return raw.withColumn("attrs", F.str_to_map("attributes", F.lit(";"), F.lit("="))).drop("attributes")


def attr(name: str) -> Column:
    """Decoded text of one attribute; null when absent."""
    value = F.try_element_at(F.col("attrs"), F.lit(name))
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def attr_list(name: str) -> Column:
    """Comma-separated values of one attribute, each decoded; empty when absent."""
    value = F.try_element_at(F.col("attrs"), F.lit(name))
    items = F.split(F.replace(value, F.lit("+"), F.lit("%2B")), ",")
    return F.coalesce(F.transform(items, F.url_decode), F.array().cast("array<string>"))


def of_type(features: DataFrame, *types: str) -> DataFrame:
    return features.filter(F.col("type").isin(*types))
