"""Removal of byte strings that repeat anywhere in the corpus, by rank doubling over sampled suffixes.

A plain prefix doubling sorts every position of the corpus again and again. Here positions
are sampled by content: every window of ``LENGTH`` bytes owns the position in it whose
``GRAM``-byte string has the smallest hash (its anchor), so equal windows have equal anchors at
equal offsets, and the windows of one anchor are neighbours. An anchor's block is the
range of its windows; blocks are ranked by fingerprints, and Spark brings equal
ranks together:

* the *core* rank, of the bytes that all windows of the block share; a core that occurs once
  ends the block, none of its windows repeats;
* the *hull* rank, of all bytes that the windows cover; a hull that occurs twice ends the
  block too, all of its windows repeat.

Blocks in between are cut into blocks of fewer windows, whose cores are longer, and
ranked again, from 32 bytes up to the full length, where core and hull are the window
itself. Of equal hulls one goes on as a witness for the blocks still open. Only the edges
of repeated passages reach the last rounds, so rows are far fewer than positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import discard, short_batches, stage, text_of

LENGTH, GRAM = 200, 32
#: Windows per block in each round after the first.
BLOCKS = (16, 4, 1)
#: Bytes that one numpy pass works on.
CHUNK = 1 << 19
_NO_ID = -(1 << 63)


def _table() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) bytes from each position, by doubling."""
    h, base, n = _table()[data], 0x9E3779B97F4A7C15, 1
    while n < gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % (1 << 64), 2 * n
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_argmin(hashes: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of each ``width`` neighbouring hashes (top 40 bits)."""
    n = len(hashes)
    keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    full[:n] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)


def anchor_blocks(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, first window, last window, anchor, core rank, hull rank) of every block."""
    pending: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, CHUNK):
            part = t[at : at + CHUNK + length - 1]
            pending.append((k, at, part))
            size += len(part)
            if size >= CHUNK:
                yield from _blocks_of(pending, length, gram)
                pending, size = [], 0
    if pending:
        yield from _blocks_of(pending, length, gram)


def _blocks_of(parts: list[tuple[int, int, bytes]], length: int, gram: int):
    joined = b"".join(p for _, _, p in parts)
    ends = np.cumsum([len(p) for _, _, p in parts])
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
    anchors = sliding_argmin(hashes, length - gram + 1)
    starts = np.arange(len(anchors))
    owner = np.searchsorted(ends, starts, "right")
    valid = starts + length <= ends[owner]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    firsts = np.flatnonzero(new & valid)
    # A block ends before the next block or at its text's last window.
    lasts = np.minimum(np.append(np.flatnonzero(new), len(anchors))[np.searchsorted(np.flatnonzero(new), firsts, "right")] - 1, ends[owner[firsts]] - length)
    cores = hashes.view(np.int64)
    digest = xxhash.xxh3_64_intdigest
    for a, b, o, p in zip(firsts.tolist(), lasts.tolist(), owner[firsts].tolist(), anchors[firsts].tolist()):
        k, at, part = parts[o]
        shift = at - int(ends[o]) + len(part)
        yield k, a + shift, b + shift, p + shift, int(cores[p]), digest(joined[a : b + length]) - (1 << 63)


_ROW = "_id long, _h long, first long, last long, anchor long, core long, hull long, multi boolean"


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, hs = b.column("_id").to_pylist(), b.column("_h").to_pylist()
        rows = [(ids[k], hs[k], *r, False) for k, *r in anchor_blocks([t.encode() for t in b.column("_text").to_pylist()])]
        yield _record(rows, _ROW)


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _settle(rows: DataFrame, blob: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """Blocks whose windows all repeat, and blocks to look at closer (one per distinct hull)."""
    weight = F.sum(F.when(F.col("multi"), 2).otherwise(1))
    # Counts are combined before they are dealt, and the stored counts let a frequent core's rows be split in the join.
    cores = rows.groupBy("core").agg(weight.alias("n"), F.min("hull").alias("low"), F.max("hull").alias("high"))
    cores, cores_at = stage(cores.filter("n >= 2").select("core", (F.col("low") == F.col("high")).alias("alike")))
    kept, kept_at = stage(rows.join(cores, "core"))
    mixed = kept.filter("NOT alike")
    place = ["_id", "_h", "first", "last", "anchor", *(["blob"] if blob else [])]
    hulls, hulls_at = stage(
        mixed.groupBy("core", "hull").agg((weight >= 2).alias("again"), F.min(F.struct(*place)).alias("one"))
    )
    span = ["_id", "_h", "first", "last"]
    known = mixed.filter("NOT multi").join(hulls.filter("again").select("core", "hull"), ["core", "hull"], "left_semi")
    spans = kept.filter("alike AND NOT multi").select(*span).unionByName(known.select(*span))
    return spans, hulls.select("one.*", F.col("again").alias("multi")), [kept_at, hulls_at, cores_at]


def _finer(block: int, length: int):
    """Cut open blocks into blocks of ``block`` windows, aligned by the anchor's offset in the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a, p, blob = r["first"], r["anchor"], r["blob"]
                low, high = p - r["last"], p - a  # the anchor's offsets in the block's windows
                for x in range(low // block * block, high + 1, block):
                    lo, hi = max(low, x), min(high, x + block - 1)
                    core = blob[p - x - a : p - x - block + 1 + length - a]
                    hull = blob[p - hi - a : p - lo - a + length]
                    rows.append(
                        (
                            r["_id"], r["_h"], p - hi, p - lo, p,
                            digest(core, x) - (1 << 63), digest(hull, x << 16 | (lo - x) << 8 | hi - x) - (1 << 63),
                            r["multi"], hull,
                        )
                    )
            yield _record(rows, _ROW + ", blob binary")

    return cut


def _fetch(batches: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """The bytes of each open block."""
    for b in batches:
        rows = []
        for i, h, text, spots in zip(*(b.column(c).to_pylist() for c in ("_id", "_h", "_text", "spots"))):
            data = text.encode()
            rows += [(i, h, s["first"], s["last"], s["anchor"], s["multi"], data[s["first"] : s["last"] + length]) for s in spots]
        yield _record(rows, "_id long, _h long, first long, last long, anchor long, multi boolean, blob binary")


def _cut_out(length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, spots in zip(*(b.column(c).to_pylist() for c in ("_id", "_text", "spots"))):
                data, at, kept, spans, removed = text.encode(), 0, [], 0, 0
                for a, z in merged(((s["first"], s["last"] + length) for s in spots or ())):
                    kept.append(data[at:a])
                    at, spans, removed = z, spans + 1, removed + z - a
                kept = b"".join((*kept, data[at:]))
                rows.append((None if i == _NO_ID else i, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield _record(rows, _OUT)

    return cut


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merged(spans) -> list[tuple[int, int]]:
    """Sorted, with overlapping and touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``_id, _h, first, last``: ranges of window starts whose windows all occur elsewhere too.

    ``docs`` has ``_id, _h, _text``; ``_id`` and ``_h`` together name a text.
    """
    spark = docs.sparkSession
    ranked = docs.filter(F.octet_length("_text") >= length).mapInArrow(_first_ranks, _ROW)
    spans, open_blocks, _ = _settle(ranked, blob=False)
    spots = open_blocks.groupBy("_id", "_h").agg(F.collect_list(F.struct("first", "last", "anchor", "multi")).alias("spots"))
    blocks, at = stage(_one_each(docs, spots).mapInArrow(_fetch, "_id long, _h long, first long, last long, anchor long, multi boolean, blob binary"))
    for size in BLOCKS:
        more, open_blocks, _ = _settle(blocks.mapInArrow(_finer(size, length), _ROW + ", blob binary"), blob=True)
        spans, blocks = spans.unionByName(more), open_blocks
    discard(spark, at)
    return spans


def _one_each(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """Texts with their spots; a text that several rows share under one id comes once."""
    joined = docs.join(spots, ["_id", "_h"])
    nth = F.row_number().over(Window.partitionBy("_id", "_h").orderBy(F.lit(0)))
    return joined.withColumn("_n", nth).filter("_n = 1").drop("_n")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (the bytes left).

    Every byte inside a ``length``-byte string that also starts somewhere else, in the same
    document or another, is removed; overlapping occurrences count, and strings are judged on the
    input. Texts are UTF-8 bytes, so a cut may split a character. Null text: the empty
    text. Texts shorter than ``length`` stay whole. Rows that repeat id and text are copies of one
    another; rows with a null id are documents like others. An empty table gives an empty
    result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"),
        F.xxhash64(text_of()).alias("_h"),
        text_of().alias("_text"),
    )
    spots = repeated_windows(named, length).groupBy("_id", "_h").agg(F.collect_set(F.struct("first", "last")).alias("spots"))
    out = named.join(spots, ["_id", "_h"], "left").mapInArrow(_cut_out(length), _OUT)
    return out if keep_text else out.drop("kept")
