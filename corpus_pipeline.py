"""The corpus pipeline: poor, copied and nearly copied documents go, the sources are mixed, the rest is packed.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes its result to the shared folder and
hands the written table to the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.llm.common import discard, tables_of, text_of
from splicelake.llm.exact_dedup import distinct_documents
from splicelake.llm.jaccard import near_groups
from splicelake.llm.mixing import mix, word_count
from splicelake.llm.packing import pack, token_pieces
from splicelake.llm.quality import good_documents
from splicelake.llm.queries import tokenizer_path
from splicelake.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return good_documents(docs.select(*COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return distinct_documents(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, four fifths of their union shared."""
    kept = near_groups(docs, words=5, percent=80).filter("kept")
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    hashed = docs.select(*COLUMNS, F.xxhash64(text_of()).alias("_th"))
    return hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_h")), "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the 1:2:3 mix of the sources takes it."""
    taken = mix(docs).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").distinct()
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    )
    counted = docs.select(*COLUMNS, word_count(F.col("text")).alias("_words"))
    return counted.join(taken, same).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in the sequences."""
    return pack(token_pieces(docs, tokenizer_path(), with_ids=False))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Mixing is random by hash and packing needs a tokenizer: no SQL. A test compares every stage with
#: plain Python, but quality's decisions and the mix's copies with what these operators return themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``.

    A stage's intermediate tables go as soon as its result is written. Stages called by themselves leave theirs
    below the application's folder, as their frames may be read at any time.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline/{uuid.uuid4().hex}"
        with tables_of([]) as staged:
            stage(spark, docs, sf_dir).write.parquet(path)
        discard(spark, *staged)
        docs = spark.read.parquet(path)
    return docs
