"""Document fingerprints that add up: a homomorphic multiset hash, with DataFrame functions only.

A text is the multiset of its paragraphs (lines). Every paragraph is hashed to a wide vector and the
vectors are added lane by lane modulo powers of two, so the order of the paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

* 16 lanes modulo 2**32 hold the paragraph's SHA-512: equality.
* 62 lanes modulo 2**31 count the bits of a hash of each word with its predecessor in the
  paragraph: likeness, as the lanes' deviations from half estimate the inner product of
  two multisets of word pairs.
* one lane counts the word pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import WHITE, stage, text_of

STRONG_LANES, STRONG_MOD = 16, 1 << 32
#: Two bits of a hash are counted in the two halves of one long: bits s and s + 31.
PAIRED_SUMS, HALF_MOD = 31, 1 << 31
_PAIR_MASK = 1 | (1 << 31)


def paragraph_rows(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """A row per paragraph (``_par``) and one per word pair (``_pair``, a 64-bit hash) of each text."""
    paragraphs = df.select(*keys, F.explode(F.split(text, "\n")).alias("_par"))
    words = paragraphs.withColumn("_words", F.split("_par", WHITE))
    pairs = F.transform(
        "_words",
        lambda w, i: F.struct(
            F.lit(None).cast("string").alias("par"),
            F.xxhash64(F.when(i == 0, F.lit("")).otherwise(F.get(F.col("_words"), i - 1)), w).alias("pair"),
        ),
    )
    whole = F.array(F.struct(F.col("_par").alias("par"), F.lit(None).cast("long").alias("pair")))
    return words.select(*keys, F.inline(F.concat(whole, pairs))).toDF(*keys, "_par", "_pair")


def lane_sums() -> list[Column]:
    """The aggregates that add the vectors of ``paragraph_rows``."""
    digest = F.sha2(F.col("_par"), 512)
    strong = [
        F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")).alias(f"_s{i}") for i in range(STRONG_LANES)
    ]
    bits = [
        F.sum(F.shiftrightunsigned("_pair", s).bitwiseAND(F.lit(_PAIR_MASK))).alias(f"_b{s}") for s in range(PAIRED_SUMS)
    ]
    return [*strong, *bits, F.count("_pair").alias("_n")]


def vector() -> Column:
    """``struct<strong: array<long>, bits: array<long>, n: long>`` from the sums."""
    low, high = F.lit(HALF_MOD - 1), PAIRED_SUMS
    strong = F.array(*[F.pmod(F.col(f"_s{i}"), F.lit(STRONG_MOD)) for i in range(STRONG_LANES)])
    bits = F.array(
        *[F.col(f"_b{s}").bitwiseAND(low) for s in range(PAIRED_SUMS)],
        *[F.shiftrightunsigned(f"_b{s}", high).bitwiseAND(low) for s in range(PAIRED_SUMS)],
    )
    return F.struct(strong.alias("strong"), bits.alias("bits"), F.col("_n").alias("n"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets joined (or, with -1, of ``a`` without ``b``): no text is read again."""
    lanes = lambda f, m: F.zip_with(a[f], b[f], lambda x, y: F.pmod(x + sign * y, F.lit(m)))
    return F.struct(
        lanes("strong", STRONG_MOD).alias("strong"), lanes("bits", HALF_MOD).alias("bits"), (a["n"] + sign * b["n"]).alias("n")
    )


def as_text(v: Column) -> Column:
    """Lower-case hex, fixed width for the equality lanes, dot-separated for the others."""
    strong = F.array_join(F.transform(v["strong"], lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.lower(F.concat_ws(".", strong, F.hex(v["n"]), F.array_join(F.transform(v["bits"], F.hex), ".")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the estimated inner product over the sum of the squared lengths; 1 for equal vectors."""
    centred = lambda v: F.transform(v["bits"], lambda x: (2 * x - v["n"]).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    x, y = centred(a), centred(b)
    norm = dot(x, x) + dot(y, y)
    estimate = F.least(F.greatest(2 * dot(x, y) / norm, F.lit(0.0)), F.lit(1.0))
    return F.when(a["strong"] == b["strong"], 1.0).when(norm > 0, estimate).otherwise(0.0)


def fingerprints(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``vector`` of every text; ``keys`` must tell the rows apart. Null text: the empty text."""
    rows = paragraph_rows(df.withColumn(text, text_of(text)), text, keys)
    return rows.groupBy(*keys).agg(*lane_sums()).select(*keys, vector().alias("vector"))


_NO_ID = -(1 << 63)


def _successors(docs: DataFrame) -> DataFrame:
    """``_k, _next, _need``: each id, the id after it (the last: the first), and the characters wanted of that one.

    Ids are range-partitioned and stored; inside a stored part the next id is the next row, and
    one row per part links it with the following part.
    """
    ids = docs.groupBy("_k").agg(F.max(F.floor(F.char_length("_text") / 4)).cast("int").alias("_need"))
    ids, _ = stage(ids.repartitionByRange("_k").select("*", F.spark_partition_id().alias("_part")))
    parts = ids.groupBy("_part").agg(F.min("_k").alias("_first"))
    everyone = Window.orderBy("_first")
    following = parts.select(
        "_part", F.coalesce(F.lead("_first").over(everyone), F.min("_first").over(Window.partitionBy(F.lit(0)))).alias("_follows")
    )
    inside = F.lead("_k").over(Window.partitionBy("_part").orderBy("_k"))
    return ids.withColumn("_inside", inside).join(following, "_part").select("_k", F.coalesce("_inside", "_follows").alias("_next"), "_need")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document, by ascending ``doc_id``.

    The edited text has the last floor(n/4) code points replaced by the first as many (or all)
    of the next document; after the last comes the first. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A null text is the empty text, which has one empty paragraph. Rows that repeat an id are kept
    apart, and the smallest of their texts serves as next document; a null id comes
    before all others. A single document is its own successor. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_k"), text_of().alias("_text"))
    after, after_path = stage(_successors(base))
    same_id = Window.partitionBy("_k").orderBy("_text")
    heads = (
        base.withColumn("_repeat", F.lag("_k").over(same_id))
        .filter("_repeat IS NULL")
        .select(F.col("_k").alias("_next"), F.col("_text").alias("_full"))
        .join(after, "_next")
        .select("_k", F.expr("substring(_full, 1, _need)").alias("_head"))
    )
    numbered = base.withColumn("_row", F.row_number().over(same_id))
    cut = F.floor(F.char_length("_text") / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.char_length("_text") - cut), F.substring("_head", F.lit(1), cut))
    texts = numbered.join(heads, "_k").select("_k", "_row", "_text", edited.alias("_edited"))
    # Both texts' rows share one key, so one pass over the joined texts adds both vectors.
    facts = texts.select(
        "_k",
        "_row",
        F.char_length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        F.posexplode(F.array("_text", "_edited")).alias("_which", "_t"),
    )
    keys = ["_k", "_row", "_which", "n_chars", "edited_sha256"]
    vectors = fingerprints(facts, "_t", keys)
    pick = lambda n: F.max(F.when(F.col("_which") == n, F.col("vector")))
    both = vectors.groupBy("_k", "_row", "n_chars", "edited_sha256").agg(pick(0).alias("own"), pick(1).alias("edited"))
    both, _ = stage(both)
    following = both.filter("_row = 1").select(F.col("_k").alias("_next"), F.col("own").alias("next_own"))
    linked = after.select("_k", "_next").join(following, "_next").select("_k", "next_own")
    return both.join(linked, "_k").select(
        F.nullif("_k", F.lit(_NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
