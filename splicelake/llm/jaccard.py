"""Near-duplicate groups by a prefix-tree join over word n-gram sets.

1. Every text becomes the set of its n-gram hashes in one global order: roughly by how many
   documents hold them, then by hash. The counts come from a table of fixed size that
   all documents fill; any order is exact, a good one keeps common n-grams out of the prefixes.
2. Texts with equal sets are one node. Two nodes can only be linked if their prefixes, the
   first ``size - required overlap + 1`` n-grams, share one. Nodes meet under (n-gram, size band).
3. In each such group every node is first paired with one pivot, a few times with other
   pivots, and only between nodes that are not connected yet; last come all pairs that are
   still in different components. A large group of near copies is soon one
   component, so it never makes all its pairs.
4. A pair passes length, position and bit-parity bounds, all of them safe, before its sets are
   read. The sets of all nodes to be compared with one probe are stored in a tree by the global order
   and the probe walks it, so shared beginnings are counted once, and a branch ends when the
   n-grams that remain can't reach the overlap any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import discard, short_batches, stage, summed_vectors, text_of
from splicelake.llm.components import components

#: Counters of the n-gram frequency table: a fixed number, 32 MB to the driver and 4 MB broadcast.
COUNTERS_LOG2 = 22
#: Sets in one tree; a probe with more partners gets several trees.
TREE_SETS = 256
STAR_ROUNDS = 4
_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=_U) | _U(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size, _U(b))])) for b in (_BASE, _INVERSE))
    return _POWERS[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def ngram_hashes(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text.

    A-Z are lower-cased, words lie between ASCII white space. A text of fewer words has its whole
    sequence as the one n-gram, a text without words has none.
    """
    at, n = 0, len(texts)
    while at < n:
        parts, size = [], 0
        while at < n and (not parts or size < 1 << 19):
            parts.append(texts[at].encode().lower() + b"\n")
            size += len(parts[-1])
            at += 1
        yield from _chunk_hashes(parts, words)


def _chunk_hashes(parts: list[bytes], words: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"".join(parts), np.uint8)
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))
    edges = np.searchsorted(starts, np.cumsum([0] + [len(p) for p in parts]))
    if len(hashes) >= words:
        grams = np.full(len(hashes) - words + 1, _U(words))
        for k in range(words):
            grams = _mix(grams * _U(_BASE) + hashes[k : k + len(grams)])
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if z - a >= words:
            yield np.unique(grams[a : z - words + 1])
        elif z > a:
            short = np.full(1, _U(z - a))
            for k in range(a, z):
                short = _mix(short * _U(_BASE) + hashes[k : k + 1])
            yield short
        else:
            yield np.empty(0, _U)


def needed_overlap(a, b, percent: int):
    """Smallest overlap of sets of ``a`` and ``b`` with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """A frequency class (0 to 63) for each of the table's counters, from the n-grams of all documents."""
    blocks, width = 64, (1 << COUNTERS_LOG2) // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTERS_LOG2, np.uint32)
        for b in batches:
            for h in ngram_hashes(b.column(0).to_pylist(), words):
                np.add.at(table, (h >> _U(64 - COUNTERS_LOG2)).astype(np.int64), 1)
        rows = table.reshape(blocks, width)
        used = [k for k in range(blocks) if rows[k].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([rows[k].astype("<u4").tobytes() for k in used], pa.binary())], names=["k", "v"]
        )

    table = np.zeros((blocks, width), np.int64)
    for block, counts in summed_vectors(docs.select("_text").mapInArrow(count, "k int, v binary"), "<u4", "<i8").items():  # 64 of 512 KB
        table[block] = counts
    return np.minimum(np.log2(np.maximum(table.ravel(), 1)), 63).astype(np.uint8)


def ordered_set(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The set in the global order, as 63-bit numbers: frequency class, then hash."""
    kind = classes[(hashes >> _U(64 - COUNTERS_LOG2)).astype(np.int64)].astype(_U)
    return np.sort((kind << _U(57)) | (hashes >> _U(7))).astype(np.int64)


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bit map of the parity of the tokens that fall on each bit; longer sets have longer maps."""
    bits = 64
    while bits < 2 * len(tokens) and bits < 1 << 16:
        bits *= 2
    return np.packbits((np.bincount(tokens & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the size of the symmetric difference of the two sets."""
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    width = 8 * len(b)
    while width > 8 * len(a):
        width //= 2
        y = (y >> width) ^ (y & ((1 << width) - 1))
    return (x ^ y).bit_count()


def tree_overlaps(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> dict[int, int]:
    """Overlap with ``probe`` of each set that reaches the needed one; ``sets`` form a prefix tree.

    The sets, sorted by their tokens, are a tree whose branches are ranges: all sets of a
    range begin alike, and that beginning is counted once.
    """
    order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: sets[k].astype(">i8").tobytes())
    found: dict[int, int] = {}
    todo = [(0, len(order), 0, 0)]
    while todo:
        low, high, depth, overlap = todo.pop()
        if low >= high:
            continue
        first, last = sets[order[low]], sets[order[high - 1]]
        shared = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:shared] != last[depth:shared])
        end = depth + int(differ[0]) if len(differ) else shared
        edge = first[depth:end]
        if len(edge):
            spot = np.searchsorted(probe, edge)
            overlap += int((probe[np.minimum(spot, len(probe) - 1)] == edge).sum())
        sizes = [len(sets[k]) for k in order[low:high]]
        after = len(probe) - (int(np.searchsorted(probe, first[end - 1], "right")) if end else 0)
        if overlap + min(after, max(sizes) - end) < needed_overlap(len(probe), min(sizes), percent):
            continue
        while low < high and len(sets[order[low]]) == end:  # sets that end here
            if overlap >= needed_overlap(len(probe), end, percent):
                found[order[low]] = overlap
            low += 1
        at = low
        while at < high:  # a child for each next token
            token, child = sets[order[at]][end], at
            while at < high and sets[order[at]][end] == token:
                at += 1
            todo.append((child, at, end, overlap))
    return found


_NODE = "doc_id long, text_hash long, size int, node long, parity binary, sign array<long>, prefix array<long>"


def _noder(classes, words: int, percent: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for b in batches:
            sizes, nodes, parity, signs, prefix = [], [], [], [], []
            for h in ngram_hashes(b.column("_text").to_pylist(), words):
                s = ordered_set(h, table)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(np.sort(h).tobytes()) - (1 << 63) if len(s) else None)
                parity.append(parity_bits(s))
                signs.append(np.frombuffer(np.packbits((np.bincount(s & 511, minlength=512) & 1).astype(np.uint8)).tobytes(), "<i8"))
                prefix.append(s[: len(s) + (percent * len(s)) // -100 + 1] if len(s) else [])
            arrays = [b.column("doc_id"), b.column("_h"), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(parity, pa.binary()), pa.array(signs, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _NODE.split(", ")])

    return make


def _setter(classes, words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        for b in batches:
            sets = [ordered_set(h, table) for h in ngram_hashes(b.column("_text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

    return make


def _required(a: Column, b: Column, percent: int) -> Column:
    return F.floor(((a + b) * percent + (100 + percent - 1)) / F.lit(100 + percent))


def _may_link(percent: int) -> Column:
    """Length bound, and what is left of both sets behind the shared token."""
    left = F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    sizes = F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent
    # Tokens before the shared one are few: at most the smaller position can be shared too.
    return sizes & (F.least("a_pos", "b_pos") + left >= _required(F.col("a_size"), F.col("b_size"), percent))


def _signs_agree(percent: int) -> Column:
    """The 512 parity bits of both sides differ no more than linked sets can: a bound for the join itself."""
    apart = sum((F.bit_count(F.get("a_sign", F.lit(i)).bitwiseXOR(F.get("b_sign", F.lit(i)))) for i in range(8)), F.lit(0))
    sizes = F.col("a_size") + F.col("b_size")
    return apart <= sizes - 2 * _required(F.col("a_size"), F.col("b_size"), percent)


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose parity maps do not rule a link out."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a_size", "b_size", "a_parity", "b_parity")))
            mask = [parity_distance(p, q) <= m + n - 2 * needed_overlap(m, n, percent) for m, n, p, q in rows]
            yield b.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"{s}_size"), F.col("parity").alias(f"{s}_parity"))
    joined = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    return stage(joined.mapInArrow(keep, "a long, b long"))[0]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are links: each probe walks the trees of its partners' sets."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        probe = pdf[pdf["b"].isna()]
        others = pdf[pdf["b"].notna()]
        found = tree_overlaps(np.asarray(probe["tokens"].iloc[0]), [np.asarray(t) for t in others["tokens"]], percent)
        partners = others["b"].to_numpy()
        return pd.DataFrame({"a": int(pdf["a"].iloc[0]), "b": np.array([int(partners[k]) for k in found], np.int64)})

    fan = pairs.groupBy("a").agg(F.ceil(F.count("*") / TREE_SETS).alias("trees"))
    dealt = pairs.join(fan, "a").withColumn("tree", F.pmod(F.xxhash64("b"), "trees"))
    partners = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "tree", F.col("b").cast("string").alias("b"), "tokens")
    probes = dealt.select("a", "tree").distinct().join(sets.withColumnRenamed("node", "a"), "a")
    rows = partners.unionByName(probes.select("a", "tree", F.lit(None).cast("string").alias("b"), "tokens"))
    return stage(rows.groupBy("a", "tree").applyInPandas(walk, "a long, b long"))[0]


def near_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, n_shingles, component_id, kept``.

    Two documents are linked when 100 * overlap >= ``percent`` * union of their n-gram sets;
    the component's id is the smallest id that links reach. Exactly the row with the smallest
    (id, text) of a component has ``kept``, and its repetitions if rows repeat. Null or empty
    texts and texts without words have an empty set and are linked with nothing; their
    component is their own id. Null ids come last. Sets are told apart by 64-bit hashes. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("_h"), text_of().alias("_text"))
    classes = spark.sparkContext.broadcast(frequency_classes(named, words))
    made, _ = stage(named.mapInArrow(_noder(classes, words, percent), _NODE))
    nodes, _ = stage(
        made.filter("size > 0").groupBy("node").agg(
            F.max("size").alias("size"), F.max("parity").alias("parity"), F.max("sign").alias("sign"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
        )
    )

    # Prefix tokens that several nodes share, one exchange for both sides of the join.
    rows = made.filter("size > 0").select("node", "size", F.posexplode("prefix").alias("pos", "token")).repartition("token")
    shared = rows.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token")
    met = rows.join(shared, "token").distinct()
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    met, _ = stage(met.withColumn("band", F.explode(F.array(band, band + 1))))
    groups = met.groupBy("token", "band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    groups, _ = stage(groups)

    def side(df: DataFrame, s: str, *more: str) -> DataFrame:
        return df.select("token", "band", *[F.col(c).alias(f"{s}_{c}" if c != "node" else s) for c in ("node", "size", "pos", *more)])

    def star(members: DataFrame, salt: int | None) -> DataFrame:
        """Each member with its group's pivot, where they are not connected yet."""
        # Later pivots differ from token to token, so a node meets many of them in one round.
        rank = F.col("node") if salt is None else F.xxhash64(F.lit(salt), "token", "node")
        pivots = members.groupBy("token", "band").agg(F.min_by(F.struct("node", "size", "pos", "comp"), rank).alias("p"))
        pivots = pivots.select("token", "band", "p.*")
        both = side(members, "a", "comp").join(side(pivots, "b", "comp"), ["token", "band"])
        return _oriented(both.filter("a_comp <> b_comp").filter(_may_link(percent)))

    members = met.join(groups.select("token", "band"), ["token", "band"]).withColumn("comp", F.col("node"))
    crowd = met.join(groups.filter("n > 2").select("token", "band"), ["token", "band"])
    sets: DataFrame | None = None

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets of the pairs' nodes; only nodes not met before have their texts read."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if sets is not None:
            wanted = wanted.join(sets, "node", "left_anti")
        chosen = nodes.join(wanted, "node").select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("_h1"))
        met_texts = named.join(chosen.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_h1")))
        # Repeated rows share id and text; one of them is enough.
        nth = F.row_number().over(Window.partitionBy("node").orderBy("doc_id"))
        texts = met_texts.withColumn("_n", nth).filter("_n = 1").select("node", "_text")
        found, _ = stage(texts.mapInArrow(_setter(classes, words), "node long, tokens array<long>"))
        return found if sets is None else sets.unionByName(found)

    links = roots = None
    for turn in range(-1, STAR_ROUNDS + 1):
        done: list[str] = []  # tables that only this turn reads
        if turn < 0:
            pairs = star(members, None)
        else:
            if roots is None:
                open_rows = crowd.withColumn("comp", F.col("node"))
            else:
                known = roots.select("node", F.col("root").alias("comp"))
                open_rows = crowd.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            mixed = open_rows.groupBy("token", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
            open_rows, open_at = stage(open_rows.join(mixed.select("token", "band"), ["token", "band"]))
            done.append(open_at)
            if turn < STAR_ROUNDS:
                pairs = star(open_rows, turn)
            else:
                signed, signed_at = stage(open_rows.join(nodes.select("node", "sign"), "node"))
                done.append(signed_at)
                both = side(signed, "a", "comp", "sign").join(side(signed, "b", "comp", "sign"), ["token", "band"])
                pairs = _oriented(both.filter("a < b AND a_comp <> b_comp").filter(_may_link(percent) & _signs_agree(percent)))
        likely = _alike(pairs, nodes, percent)
        discard(spark, *done)
        if not likely.limit(1).count():
            continue
        sets = sets_of(likely)
        more = _verified(likely, sets, percent)
        if more.limit(1).count():
            links = more if links is None else links.unionByName(more)
            roots = components(links)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    classes.unpersist()

    rooted = made.join(roots.withColumnRenamed("root", "_root"), "node", "left").withColumn("_root", F.coalesce("_root", "node"))
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    tops = rooted.filter("_root IS NOT NULL").groupBy("_root").agg(F.min(best).alias("top"))
    out = rooted.join(tops, "_root", "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("top.doc_id", "doc_id").alias("component_id"),
        (F.col("top").isNull() | (F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash")))).alias("kept"),
    )


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
