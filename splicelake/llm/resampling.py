"""Importance resampling towards a target: hashed n-gram gains, scores with noise of their own, a radix sort for the ranks.

The two histograms have a fixed number of buckets, so the gains are a small array, and documents are
scored against it without a shuffle. Ranks come from a least-significant-digit radix sort in
DataFrame functions: each pass counts the digits of every part of the table, turns the counts into
offsets and so knows every row's place in the order by that digit.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import bounded_batches, discard, stage, text_of

#: Byte by byte: letters to lower case, digits and everything beyond ASCII kept, the rest a blank.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
BITS = 12
#: Rows that share a part in a counting pass. A task holds one digit of one part at a time.
PART = 1 << 20


class Buckets(dict):
    """The bucket of each feature met lately, by its bytes; emptied when it holds ``most`` of them."""

    def __init__(self, buckets: int, most: int = 500_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8: one table turns A-Z to a-z and all other ASCII but letters and digits to a blank; bytes of other characters stay."""
    return text.translate(TO_WORDS).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one blank."""
    features = words
    for n in range(2, longest + 1):
        features = features + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return features


def histogram(docs: DataFrame, longest: int, buckets: int, text: str = "text") -> list[int]:
    """Features per bucket over all rows.

    A task sends one number per bucket; ``buckets`` sums reach the driver, whatever the table's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for raw in b.column("_text").to_pylist():
                features = features_of(words_of(raw), longest)
                total += np.bincount(np.fromiter(map(known.__getitem__, features), np.int64, len(features)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    with bounded_batches(docs.sparkSession):
        parts = docs.select(text_of(text).cast("binary").alias("_text")).mapInArrow(count, "bucket int, n long")
        found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = [0] * buckets
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, one added to every count."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def with_scores(docs: DataFrame, gains: list[int], longest: int, seed: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row, without a shuffle: the gains are an array that each task holds."""
    table = np.array(gains, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(table))
        for b in batches:
            rows = []
            for raw in b.column("_text").to_pylist():
                words = words_of(raw)
                features = features_of(words, longest)
                total = int(table[np.fromiter(map(known.__getitem__, features), np.int64, len(features))].sum())
                rows.append((len(words), len(features), total // len(features) if features else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("_text"))
    weighed = texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def counting_pass(rows: DataFrame, digit: Column) -> DataFrame:
    """Every row of ``rows`` (``pos``, ``part`` and its keys) at its place in the stable order by ``digit``.

    The rows of a part are counted by digit where they lie. A digit starts behind all smaller
    ones; within it, parts follow each other in order; within a part, rows keep their order. So a row's place is the sum
    of three numbers, and only the last needs the rows themselves: those of one digit in one part, at most ``PART``.
    """
    marked = rows.withColumn("_digit", digit.cast("int"))
    counts = marked.groupBy("_digit", "part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.select("_digit", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_within"))
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_n"))  # 2 ** BITS rows at most
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_digit", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_start"))
    offsets = within.join(starts, "_digit").select("_digit", "part", (F.col("_within") + F.col("_start")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_digit", "part").orderBy("pos")) - 1
    placed = marked.withColumn("_local", local).join(offsets, ["_digit", "part"])
    place = F.col("_offset") + F.col("_local")
    kept = [c for c in rows.columns if c not in ("pos", "part")]
    return placed.select(*kept, place.alias("pos")).withColumn("part", F.floor(F.col("pos") / F.lit(PART)))


def digits_of(low: int | None, high: int | None) -> int:
    """Digits in which 64-bit numbers between ``low`` and ``high`` can differ."""
    return 0 if low is None or high is None else -(-((low ^ high) & (1 << 64) - 1).bit_length() // BITS)


def radix_ranks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in ascending order of ``keys``, most significant key first.

    Keys are integers of at most 64 bits; a null comes after every number. Passes run from the last key's least digit to the
    first key's greatest. A digit on which all rows agree would move nothing and has no pass. Each pass is written
    to the shared folder, so places never change when a task is repeated; rows that agree in all keys
    keep the order in which the first table was written.
    """
    spark = rows.sparkSession
    flip = F.lit(-(1 << 63))  # signed numbers in the order of unsigned ones
    coded = {f"_k{i}": F.col(k).cast("long").bitwiseXOR(flip) for i, k in enumerate(keys)}
    at = F.monotonically_increasing_id()
    now, path = stage(rows.withColumns(coded).withColumn("pos", at).withColumn("part", F.shiftright("pos", 33)))
    ends = now.agg(
        *[f(F.col(k).cast("long")).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))],
        *[F.max(F.col(k).isNull()).alias(f"no{i}") for i, k in enumerate(keys)],
    ).first()
    passes: list[Column] = []
    for i in reversed(range(len(keys))):
        key = F.col(f"_k{i}")
        for d in range(digits_of(ends[f"lo{i}"], ends[f"hi{i}"])):
            digit = F.shiftrightunsigned(key, d * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
            passes.append(F.coalesce(digit, F.lit(0)))
        if ends[f"no{i}"]:
            passes.append(key.isNull().cast("int"))
    passes = passes or [F.lit(0)]
    for digit in passes:
        old = path
        now, path = stage(counting_pass(now, digit))
        discard(spark, old)
    return now.drop(*coded, "part")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null where a row isn't drawn.

    Of the N rows with ``least_words`` words, floor(``percent`` * N / 100) with the highest scores are drawn without replacement
    (the noise in the score is Gumbel's), ties to the smaller id. A null text has no features and weight 0; a null id
    draws its noise as an empty one and ranks behind equal scores; repeated rows have equal scores and each their own
    rank. Other columns of either table aren't read. An empty target leaves only the added ones; an empty
    ``docs`` gives no rows.
    """
    gains = bucket_gains(histogram(docs, longest, buckets, text), histogram(target, longest, buckets, text))
    with bounded_batches(docs.sparkSession):
        scored, _ = stage(with_scores(docs, gains, longest, seed, id_col, text).withColumn("_row", F.monotonically_increasing_id()))
    able = scored.filter(F.col("n_words") >= least_words)
    ranked = radix_ranks(able.select("_row", "doc_id", (-F.col("score")).alias("_down")), ["_down", "doc_id"])
    wanted = able.count() * percent // 100
    first = ranked.filter(F.col("pos") < wanted).select("_row", (F.col("pos") + 1).alias("rank"))
    return scored.join(first, "_row", "left").select("doc_id", "n_features", "weight", "score", "rank")
