"""Line de-duplication by a segment-partition edit join.

Equal lines belong together whatever their length, by their hash. Lines may also differ by an edit for every
``PER_EDIT`` characters of the shorter one, up to ``tau``: none below 12 characters, one from 12, two from 24.

Two lines within ``tau`` edits share one of ``tau + 1`` segments of the shorter one, as ``tau`` edits
can't touch all of them, and the segment lies in the longer line at most a few characters off.
Every distinct line that may differ is indexed by its segments (with its length and the segment's number), and
probes the indexes of its own length and of up to ``tau`` less with the substrings that can be
such segments; the edits are those of the shorter length. First the probes under a key meet one pivot, twice, and classes are formed; then all meet
that are still in different classes, so a large class never makes all its pairs. Pairs that meet and whose parities of bigrams and characters are close are verified by a
banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import short_batches, stage, text_of
from splicelake.llm.components import components

#: Most edits allowed between two lines, and the characters from which that many are allowed.
TAU, MIN_CHARS = 2, 24
#: Characters of the shorter line for each edit.
PER_EDIT = 12
#: Rounds in which the lines under a key meet one pivot only, before all that are not connected yet meet.
STAR_ROUNDS = 2


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(start, size) of nearly equal segments, the longer ones last."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        n = size + (k >= parts - longer)
        out.append((at, n))
        at += n
    return out


def edits_of(length: int, tau: int) -> int:
    """Edits by which a line of ``length`` characters may differ from a longer one."""
    return min(tau, length // PER_EDIT)


def probe_places(own: int, other: int, tau: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line of ``own`` characters to look up for lines of ``other``.

    The start of a segment can move by the edits before it, of which there are at most as many as
    segments before it if an earlier segment does not match, and likewise seen from the end.
    """
    shift, out = own - other, []
    for k, (p, n) in enumerate(segments(other, tau + 1)):
        low = max(p - k, p + shift - (tau - k), 0)
        high = min(p + k, p + shift + (tau - k), own - n)
        out += [(k, s, n) for s in range(low, high + 1)]
    return out


def edit_distance_within(a: str, b: str, tau: int) -> bool:
    """Is the edit distance at most ``tau``? Bit-parallel over a band of 2 * tau + 1 diagonals.

    Bit d of ``reach[e]`` says that with ``e`` edits some row is reached on diagonal d - tau;
    equal characters move it on within its diagonal, for all diagonals of the band at once.
    """
    m, n = len(a), len(b)
    if abs(m - n) > tau:
        return False
    goal, width = 1 << (n - m + tau), (1 << (2 * tau + 1)) - 1
    reach = [(1 << (tau + e + 1)) - (1 << tau) for e in range(tau + 1)]  # b's first e characters are inserted
    for i in range(m):
        same = 0
        for d in range(-tau, tau + 1):  # which diagonals have a match in this row
            j = i + d
            if 0 <= j < n and a[i] == b[j]:
                same |= 1 << (d + tau)
        new = []
        for e in range(tau + 1):
            now = reach[e] & same
            if e:
                now |= reach[e - 1] | (reach[e - 1] >> 1)  # replace; delete from a
                now |= (new[e - 1] << 1) & width  # insert from b
            new.append(now & width)
        reach = new
        if not reach[tau]:
            return False
    return bool(reach[tau] & goal)


_KEYS = "key long, line long, probe boolean"


def _keys(tau: int, least: int):
    """The index and probe rows of each distinct line of a task's batch."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, plans = xxhash.xxh3_64_intdigest, {}
        for b in batches:
            keys, lines, probes, seen = [], [], [], set()
            for text in b.column(0).to_pylist():
                for line in text.split("\n"):
                    n = len(line)
                    if n < least or not edits_of(n, tau) or line in seen:
                        continue
                    seen.add(line)
                    if n not in plans:
                        index = [(n * 8 + k, s, s + size) for k, (s, size) in enumerate(segments(n, edits_of(n, tau) + 1))]
                        look = [
                            (other * 8 + k, s, s + size)
                            for other in range(max(least, n - tau), n + 1)
                            if n - other <= edits_of(other, tau) > 0
                            for k, s, size in probe_places(n, other, edits_of(other, tau))
                        ]
                        plans[n] = index, look
                    index, look = plans[n]
                    name = digest(line) - (1 << 63)
                    keys += [digest(line[s:e], seed) - (1 << 63) for seed, s, e in index]
                    keys += [digest(line[s:e], seed) - (1 << 63) for seed, s, e in look]
                    lines += [name] * (len(index) + len(look))
                    probes += [False] * len(index) + [True] * len(look)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.int64()), pa.array(probes, pa.bool_())], names=["key", "line", "probe"])

    return make


def parities(line: str) -> tuple[int, ...]:
    """Three numbers of 64 bits: is the count of bigrams (128 classes), and of characters (64), odd in each class?"""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4")
    classes = ((codes[:-1] * np.uint32(2654435761)) ^ (codes[1:] * np.uint32(2246822519))) >> np.uint32(25)
    counts = np.concatenate([np.bincount(classes, minlength=128), np.bincount(codes & np.uint32(63), minlength=64)])
    return tuple(np.packbits((counts & 1).astype(np.uint8)).view("<i8").tolist())


SIGNS = ("sign0", "sign1", "sign2")
_LINES = "doc_id long, row long, line_no int, line long, chars int"
_TEXTS = "line long, said string, sign0 long, sign1 long, sign2 long, edits int"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line of every text: its hash and length."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        rows = []
        for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "_text"))):
            rows += [(doc, row, k, digest(line) - (1 << 63), len(line)) for k, line in enumerate(text.split("\n"))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        cols = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _LINES.split(", ")])


def _signed(tau: int):
    """The parities, and the edits allowed, beside each line in question."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("said").to_pylist()
            signs = [parities(x) for x in said]
            cols = [pa.array([x[k] for x in signs], pa.int64()) for k in range(len(SIGNS))]
            edits = pa.array([edits_of(len(x), tau) for x in said], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("line"), b.column("said"), *cols, edits], names=["line", "said", *SIGNS, "edits"])

    return make


def _close_signs():
    """Safe bound: an edit takes at most two bigrams and one character away and adds as many."""
    apart = [F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SIGNS]
    edits = F.least("a_edits", "b_edits")
    return (apart[0] + apart[1] <= 4 * edits) & (apart[2] <= 2 * edits)


def near_lines(docs: DataFrame, tau: int = TAU, least: int = 1) -> DataFrame:
    """One row per line: ``doc_id, row, line_no, line, class_doc, class_line, kept, in_class``.

    ``docs`` has ``doc_id, row, _text``; ``doc_id`` and ``row`` together name a text. Lines of at least
    ``least`` characters are linked when they are equal or within the edits of the shorter one (``edits_of``);
    the class of a line is the first line, by (doc_id, row, line_no), that links reach, and only that one is
    kept. Shorter lines are all kept and their own class; with ``least`` 1 these are the empty lines only.
    """
    lines, _ = stage(docs.mapInArrow(_lines, _LINES))
    rows = docs.select("_text").mapInArrow(_keys(tau, least), _KEYS).repartition("key")
    met = rows.groupBy("key").agg(
        F.max("probe").alias("any_probe"), F.min("probe").alias("all_probe"), F.min("line").alias("low"), F.max("line").alias("high")
    )
    met = met.filter("any_probe AND NOT all_probe AND low < high").select("key")
    shared, _ = stage(rows.join(met, "key").distinct())
    # The texts of the lines in question, from the first document that has each.
    asked = shared.select("line").distinct()
    where = lines.join(asked, "line").groupBy("line").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("at")).select("line", "at.*")
    spots = where.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line", "line_no")).alias("spots"))
    there = docs["doc_id"].eqNullSafe(spots["doc_id"]) & (docs["row"] == spots["row"])
    picked = docs.join(spots, there).select("spots", F.split("_text", "\n").alias("all"))
    texts = picked.select("all", F.explode("spots").alias("s")).select(F.col("s.line").alias("line"), F.get("all", "s.line_no").alias("said"))
    signed, _ = stage(texts.dropDuplicates(["line"]).mapInArrow(_signed(tau), _TEXTS))
    named, _ = stage(shared.join(signed.drop("said"), "line"))
    texts = signed.select("line", "said")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = zip(b.column("x").to_pylist(), b.column("y").to_pylist())
            near = [edit_distance_within(x, y, edits_of(min(len(x), len(y)), tau)) for x, y in said]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("key", F.col("line").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("comp", *SIGNS, "edits")])

    links = roots = None
    for turn in range(STAR_ROUNDS + 1):
        known = named.withColumn("comp", F.col("line"))
        if roots is not None:
            known = named.join(roots, "line", "left").withColumn("comp", F.coalesce("root", "line")).drop("root")
        mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        known = known.join(mixed.select("key"), "key")
        indexed = known.filter("NOT probe")
        if turn < STAR_ROUNDS:
            # Pivots differ from key to key, so a line meets several of them in one round.
            pivot = F.min_by(F.struct("line", "comp", *SIGNS, "edits"), F.xxhash64(F.lit(turn), "key", "line"))
            indexed = indexed.groupBy("key").agg(pivot.alias("p")).select("key", "p.*")
        met = side(known.filter("probe"), "a").join(side(indexed, "b"), "key").filter("a_comp <> b_comp").filter(_close_signs())
        pairs, _ = stage(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        compared = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        more, _ = stage(compared.mapInArrow(verify, "a long, b long"))
        if roots is None or more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            roots = components(links).withColumnRenamed("node", "line")
    rooted = lines.join(roots, "line", "left").withColumn(
        "_class", F.when(F.col("chars") >= least, F.coalesce("root", "line"))
    )
    here = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "line_no")
    tops = rooted.filter("_class IS NOT NULL").groupBy("_class").agg(F.min(here).alias("top"))
    out = rooted.join(tops, "_class", "left")
    top = F.coalesce(F.col("top"), here)
    return out.select(
        "doc_id", "row", "line_no", "line", top["doc_id"].alias("class_doc"), top["line_no"].alias("class_line"),
        (top == here).alias("kept"), F.col("_class").isNotNull().alias("in_class"),
    )


def line_dedup(docs: DataFrame, tau: int = TAU, least: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_dropped, dropped`` (numbers of dropped lines, from 0).

    Lines lie between line feeds. Null text: one empty line, kept. Rows that repeat an id with other
    texts are documents of their own. Of rows that repeat id and text one is reported as the first, and the others
    lose every line that takes part, as equal texts of other ids would. Null ids come last. An empty table gives an
    empty result; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("_text"))
    decided = near_lines(named, tau, least).groupBy("doc_id", "row", "line_no").agg(
        (~F.max("kept")).alias("out"), F.max("in_class").alias("out_again"), F.count("*").alias("copies")
    )

    def gone(flag: str) -> list:
        numbers = F.array_sort(F.collect_list(F.when(F.col(flag), F.col("line_no"))))
        return [F.count_if(flag).alias(f"n_{flag}"), F.array_join(numbers, ",").alias(f"{flag}_numbers")]

    per = decided.groupBy("doc_id", "row").agg(F.count("*").alias("n_lines"), F.max("copies").alias("copies"), *gone("out"), *gone("out_again"))
    rows = per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    first = F.col("_copy") == 1
    return rows.select(
        "doc_id",
        "n_lines",
        F.when(first, F.col("n_out")).otherwise(F.col("n_out_again")).alias("n_dropped"),
        F.when(first, F.col("out_numbers")).otherwise(F.col("out_again_numbers")).alias("dropped"),
    )
