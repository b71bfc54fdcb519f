"""Incremental id mapping: new mapping files update the accession of each protein."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from splicelake.operators.idmapping import mapping_hits, resolve_collision

MAPPING_SCHEMA = "ord BIGINT, accession STRING, refseq_id STRING, enst_id STRING"
HITS = ("refseq_hit", "ensembl_hit")


def batch_hits(proteins: DataFrame, batch: DataFrame) -> DataFrame:
    """Hits of one micro-batch with the position of the line that made each."""
    hits = mapping_hits(proteins, batch.withColumn("accession", F.struct("ord", "accession")))
    return hits.select("protein_key", *HITS)


def stream_id_mapping(
    spark: SparkSession,
    mapping_dir: str,
    proteins: DataFrame,
    hits_dir: str,
    checkpoint: str,
    files_per_trigger: int = 1,
    snapshot_every: int = 20,
) -> StreamingQuery:
    """Append the hits of every new mapping file to ``hits_dir``.

    Each batch writes its own directory, so a batch that is retried after a failure replaces what it
    wrote. Every ``snapshot_every`` batches what is there is folded into a snapshot, one row per protein, so
    readers never go through more than that many batches.
    """
    lines = (
        spark.readStream.schema(MAPPING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(mapping_dir)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch_hits(proteins, batch).write.mode("overwrite").parquet(f"{hits_dir}/batch={batch_id}")
        if (batch_id + 1) % snapshot_every == 0:
            snapshot(batch.sparkSession, hits_dir, batch_id)

    return (
        lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the finished directories ``prefix=n`` of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith(f"{prefix}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(path(p, "_SUCCESS")))


def live_paths(spark: SparkSession, hits_dir: str, before: int | None = None) -> list[str]:
    """What a reader needs: the newest snapshot and the batches behind it, in order.

    ``before`` leaves out snapshots from that batch on, so that a retried batch folds anew. Spark skips the
    snapshots' folder, as its name begins with an underscore, wherever ``hits_dir`` is read as a whole.
    """
    folded = [n for n in _numbered(spark, f"{hits_dir}/_snapshots", "upto") if before is None or n < before]
    last = folded[-1] if folded else -1
    newer = [n for n in _numbered(spark, hits_dir, "batch") if n > last and (before is None or n <= before)]
    return [f"{hits_dir}/_snapshots/upto={last}"] * bool(folded) + [f"{hits_dir}/batch={n}" for n in newer]


def _latest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The latest line per protein and source; its position decides, so folding twice changes nothing."""
    return spark.read.parquet(*paths).select("protein_key", *HITS).groupBy("protein_key").agg(*[F.max(h).alias(h) for h in HITS])


def snapshot(spark: SparkSession, hits_dir: str, batch_id: int) -> None:
    """Fold the last snapshot and the batches since then, ``batch_id`` included, into the next snapshot."""
    folded = _latest(spark, live_paths(spark, hits_dir, before=batch_id))
    folded.write.mode("overwrite").parquet(f"{hits_dir}/_snapshots/upto={batch_id}")


def current_ids(spark: SparkSession, hits_dir: str, strategy: str = "ensembl") -> DataFrame:
    """Accession of every protein after all batches: the latest line per source wins."""
    latest = _latest(spark, live_paths(spark, hits_dir))
    plain = latest.select("protein_key", *[F.col(f"{h}.accession").alias(h) for h in HITS])
    return resolve_collision(plain, strategy)
