"""Mix sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source that should contribute ``target`` words out of ``source_size`` takes every
document target / source_size times: the whole part always, the fraction by chance.
Fractions meet in pairs: mass, counted in words, moves from one document to the other in a
random direction until one fraction is 0 or 1, so each document's expected copies and
the source's sum of words both stay as they were. Blocks of about ``BLOCK`` documents are
folded at once, the one fraction that is left of each block goes up to the next level, and
the last one of a source is rounded to the nearer side. A source's words therefore end
within one document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splicelake.llm.common import WORD, stage, text_of

#: Expected documents in a block of the reduction tree; a block is one array in one task.
BLOCK = 64
MAX_REPEAT = 3.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Per source: ``source, source_size, target`` (one row per source; null is a source too).

    Sources by code point, null last, take ``weights`` in turn and share all words by them.
    A target above ``max_repeat`` times its source is cut to that and the excess shared
    again: target = min(max_repeat * size, level * weight) with the level that makes
    the targets sum to the whole. A source without words gets 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(w) for w in weights])
    per = per.select("source", "source_size", F.get(turn, (rank % len(weights)).cast("int")).alias("weight"))
    cap = F.col("source_size") * F.lit(max_repeat)
    fill = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(F.lit(0))
    per = per.select(
        "*",
        cap.alias("cap"),
        F.sum("source_size").over(everyone).cast("double").alias("whole"),
        F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)).alias("cut"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = (F.col("whole") - F.col("cut")) / F.col("rest")
    # The level at the first source that its share does not push above its cap; none: all are capped.
    per = per.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cut"), level.alias("l")))).over(everyone)["l"])
    return per.select(
        "source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _chance(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _meet(seed: int):
    """One fold step: the open document of a block meets the next one."""

    def step(acc: Column, x: Column) -> Column:
        c = acc["open"]
        gain = F.least((1 - c["p"]) * c["mass"], x["p"] * x["mass"])
        loss = F.least(c["p"] * c["mass"], (1 - x["p"]) * x["mass"])
        up = _chance(seed, c["key"], x["key"]) * (gain + loss) < loss
        first_done = F.when(up, (1 - c["p"]) * c["mass"] <= gain).otherwise(c["p"] * c["mass"] <= loss)
        settled = F.struct(
            F.when(first_done, c["key"]).otherwise(x["key"]).alias("key"),
            F.when(first_done, up).otherwise(~up).alias("taken"),
        )
        left_p = F.when(first_done, F.when(up, x["p"] - gain / x["mass"]).otherwise(x["p"] + loss / x["mass"])).otherwise(
            F.when(up, c["p"] + gain / c["mass"]).otherwise(c["p"] - loss / c["mass"])
        )
        left = F.struct(
            F.when(first_done, x["key"]).otherwise(c["key"]).alias("key"),
            F.when(first_done, x["mass"]).otherwise(c["mass"]).alias("mass"),
            F.least(F.greatest(left_p, F.lit(0.0)), F.lit(1.0)).alias("p"),
        )
        return F.when(
            c.isNull(), F.struct(x.alias("open"), acc["done"].alias("done"))
        ).otherwise(F.struct(left.alias("open"), F.array_append(acc["done"], settled).alias("done")))

    return step


_KEY = "struct<source:string,doc_id:bigint,size:bigint>"


def pivotal_rounding(items: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``key, taken`` for items ``key struct<source, doc_id, size>, mass double, p double`` (0 < p < 1).

    Works level by level; a level's table is written to the shared folder, and only the
    number of blocks reaches the driver. Equal inputs give equal results.
    """
    item = f"struct<key:{_KEY},mass:double,p:double>"
    start = F.struct(
        F.lit(None).cast(item).alias("open"), F.array().cast(f"array<struct<key:{_KEY},taken:boolean>>").alias("done")
    )
    per_source = items.groupBy("key.source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks, level, done = max(1, -(-per_source // block)), 0, []
    while True:
        spread = items.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "key"), F.lit(blocks)))
        rows = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "key").alias("at"), F.struct("key", "mass", "p").alias("item"))))
        folded = spread.groupBy(F.col("key.source").alias("source"), "block").agg(rows.alias("rows")).select(
            F.aggregate(F.transform("rows", lambda r: r["item"]), start, _meet(seed + level)).alias("f")
        )
        folded, _ = stage(folded)
        done.append(folded.select(F.explode("f.done").alias("d")).select("d.key", "d.taken"))
        items = folded.select("f.open.key", "f.open.mass", "f.open.p")
        if blocks == 1:
            done.append(items.select("key", (F.col("p") >= 0.5).alias("taken")))
            break
        blocks, level = -(-blocks // block), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` is 0 to 3. Null text: size 0, so the document is worth nothing and is
    taken the whole part of the ratio. Rows that repeat id, source and size are decided
    together. Null ids and sources are values like others. An empty table gives an empty one.
    """
    sized, _ = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    goal, _ = stage(targets(sized, weights))
    units = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    g = goal.withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("ratio", F.least(ratio, F.lit(MAX_REPEAT)))
    units = units.select("*", F.floor("ratio").cast("int").alias("base"), (F.col("ratio") - F.floor("ratio")).alias("p"))
    open_ones = units.filter("p > 0 AND size > 0").select(
        F.struct("source", "doc_id", "size").alias("key"), (F.col("size") * F.col("rows")).cast("double").alias("mass"), "p"
    )
    chosen = pivotal_rounding(open_ones, seed).select(
        F.col("key.source").alias("_source"), F.col("key.doc_id").alias("_doc"), F.col("key.size").alias("_size"), "taken"
    )
    same = (
        F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("size") == F.col("_size"))
    )
    copies = F.col("base") + F.coalesce(F.col("taken").cast("int"), F.lit(0))
    decided = units.join(chosen, same, "left").withColumn("copies", copies)
    decided = decided.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return decided.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
