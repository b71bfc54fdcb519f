"""Exact de-duplication by a distributed content sort.

Rows are range-partitioned by sampled splitters on (first bytes of the normalised text,
its SHA-256, id) and sorted inside each partition by Spark's external sort, so equal
texts are adjacent. One pass over each partition compares every row with the row before
it, in full, and numbers the runs of equal texts. As the id is part of the splitters, a
text that a third of all rows share is cut into several partitions; runs that touch a
partition's edge are compared with the neighbouring partition's edge and merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import WHITE, short_batches, stage, text_of

#: Bytes of the normalised text in a splitter; splitters are sampled to the driver, so they are short.
SPLITTER_BYTES = 24


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their normalised forms are. The row with the smallest id of each
    group stays; a null id counts as the largest. Rows that tie on the id too are
    interchangeable: exactly one of them has ``kept``. A null text equals the empty text.
    An empty table gives an empty result. Other columns are ignored.
    """
    marked, merged = _runs(docs, id_col, text_col, ())
    rooted = marked.join(merged, ["pid", "run"], "left").select(
        "*", F.coalesce("root_pid", "pid").alias("_rp"), F.coalesce("root_run", "run").alias("_rr")
    )
    groups = rooted.groupBy("_rp", "_rr").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rooted.join(groups, ["_rp", "_rr"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("lead") & F.col("root_pid").isNull()).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns, from the one sort alone."""
    columns = docs.columns
    marked, merged = _runs(docs, id_col, text_col, columns)
    first = marked.filter("lead").join(merged.select("pid", "run"), ["pid", "run"], "left_anti")
    return first.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def _runs(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The sorted rows with their runs (stored), and for runs that continue one of an earlier part, that one.

    ``carry`` names columns that are handed through for the first row of each run.
    """
    short_batches(docs.sparkSession)
    clean = normalised(F.col(text_col))
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).alias("_text"),
        F.unhex(F.sha2(clean, 256)).alias("_sha"),
        F.substring(clean.cast("binary"), 1, SPLITTER_BYTES).alias("_head"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry) if c != text_col],
    )
    order = [F.col("_head"), F.col("_sha"), F.col("_id").asc_nulls_last()]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    kept_cols = [(i, c, docs.schema[c].dataType) for i, c in enumerate(carry)]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"pid int, run long, lead boolean, _id {id_type}, _sha binary, first_text string, last_text string" + "".join(
        f", _c{i} {t.simpleString()}" for i, _, t in kept_cols
    )
    sources = [(f"_c{i}", "_text" if c == text_col else f"_c{i}") for i, c, _ in kept_cols]
    marked, _ = stage(placed.mapInArrow(_run_marker(sources), schema))

    # Edges: does a partition's first text equal the last text of the partition before it?
    edges = marked.groupBy("pid").agg(
        F.max("run").alias("last_run"), F.max("first_text").alias("first"), F.max("last_text").alias("last")
    )
    edges, _ = stage(edges)
    parts = Window.orderBy("pid")  # one row per partition
    before = edges.select("pid", F.lag("pid").over(parts).alias("before"))
    left = edges.select(F.col("pid").alias("before"), F.col("last").alias("left_text"))
    joins = (
        before.join(edges.select("pid", "first", "last_run"), "pid")
        .join(left, "before", "left")
        .select("pid", "last_run", _same(F.col("first"), F.col("left_text")).alias("same"))
    )
    opens = F.when(~F.col("same") | (F.col("last_run") > 0), F.struct("pid", F.col("last_run").alias("run")))
    root = F.last(opens, ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        joins.select("pid", "same", root.alias("root"))
        .filter("same")
        .select("pid", F.lit(0).cast("long").alias("run"), F.col("root.pid").alias("root_pid"), F.col("root.run").alias("root_run"))
    )
    return marked, merged


def _same(a: Column, b: Column) -> Column:
    """Equal normalised texts; false where there is no second text."""
    return F.coalesce(normalised(a) == F.when(b.isNotNull(), normalised(b)), F.lit(False))


def _run_marker(carried: Sequence[tuple[str, str]]):
    """Number the runs of equal texts in a sorted partition; each row is compared with the one before it."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = re.compile(WHITE)
        pid = TaskContext.get().partitionId()
        run, sha, text, held = -1, None, None, None
        for batch in batches:
            ids, texts, shas = (batch.column(c).to_pylist() for c in ("_id", "_text", "_sha"))
            extra = [batch.column(c).to_pylist() for _, c in carried]
            rows = [] if held is None else [held]
            for k, (i, t, s) in enumerate(zip(ids, texts, shas)):
                t = t or ""
                new = s != sha or (t != text and white.sub(" ", t) != white.sub(" ", text))
                run += new
                rows.append([pid, run, new, i, s, t if not run and new else None, None, *[x[k] if new else None for x in extra]])
                sha, text = s, t
            if rows:
                held = rows.pop()
            if rows:
                yield _as_batch(rows, batch, carried)
            last = batch
        if held is not None:
            held[6] = text
            yield _as_batch([held], last, carried)

    return mark


def _as_batch(rows: list[list], like: pa.RecordBatch, carried: Sequence[tuple[str, str]]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.bool_(), like.schema.field("_id").type, pa.binary(), pa.string(), pa.string()]
    types += [like.schema.field(c).type for _, c in carried]
    names = ["pid", "run", "lead", "_id", "_sha", "first_text", "last_text", *[n for n, _ in carried]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
