"""Delimited text per group, and its items as rows of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.operators.ordered import hot_sizes, running_by_key
from splicelake.session import staged


def group_text(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    sep: str,
    out: str,
    *,
    sort_by: Sequence[Column] = (),
    unique: bool = False,
) -> DataFrame:
    """Join the items of each group to one text, sorted by ``sort_by`` and the item.

    One row per group whatever its size, with the columns ``keys`` and ``out``; equal items meet
    only when they are to be told apart (``unique``), before any list is made.
    """
    ranks = [c.alias(f"_s{i}") for i, c in enumerate(sort_by)]
    rows = df.select(*keys, *ranks, item.alias("_item"))
    if unique:
        rows = rows.distinct()
    fields = [*[f"_s{i}" for i in range(len(ranks))], "_item"]
    sorted_items = F.array_sort(F.collect_list(F.struct(*fields)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(sorted_items, lambda s: s["_item"]), sep).alias(out))


def item_rows(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    *,
    sort_by: Sequence[Column] = (),
    unique: bool = False,
) -> DataFrame:
    """The items of each group as rows ``keys, position, item``, in the order of ``group_text``.

    Positions count from 1; null items are left out, as joined text leaves them out. A group of more than
    ``HOT_ROWS`` items is cut into as many ranges of its order as it needs, so none has to fit into one task; the
    others meet by one shuffle, which serves a grouping by ``keys`` after it as well. Items are made and written once, as counting
    them and numbering them both need them.
    """
    ranks = [c.alias(f"_s{i}") for i, c in enumerate(sort_by)]
    rows = df.select(*keys, *ranks, item.alias("item")).filter(F.col("item").isNotNull())
    if unique:
        rows = rows.distinct()
    rows = staged(rows)
    order = [*[f"_s{i}" for i in range(len(ranks))], "item"]
    counted = running_by_key(
        rows.withColumn("_one", F.lit(1).cast("bigint")), keys, order, {"position": ("sum", "_one", "through")}, hot_sizes(rows, keys)
    )
    return counted.select(*keys, "position", "item")


def text_pieces(items: DataFrame, keys: Sequence[str], sep: str, per_piece: int) -> DataFrame:
    """``keys, piece, text``: at most ``per_piece`` items of a group joined; the pieces in order, with ``sep`` between, are the whole text."""
    piece = F.floor((F.col("position") - 1) / F.lit(per_piece)).cast("bigint")
    held = items.groupBy(*keys, piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("_items"))
    return held.select(*keys, "piece", F.array_join(F.transform("_items", lambda x: x["item"]), sep).alias("text"))
