"""Ordered scans and interval joins that stay parallel inside one hot key.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Here rows are laid out by
ranges of key and order, which cuts a key wherever it has too many rows, however close these lie. Every
part is scanned on its own, and one row per cut carries the earlier (or later) parts' result across.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splicelake.session import staged

PART = "_part"
#: Keys of more rows than this are laid out in ranges by ``running_by_key``; smaller ones are one task's work.
HOT_ROWS = 100_000
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, local: Column, carry: Column | None) -> Column:
    """``carry`` is None where no key is cut."""
    if kind == "sum":
        own = F.coalesce(local, F.lit(0))
        return own if carry is None else own + F.coalesce(carry, F.lit(0))
    if carry is None:
        return local
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


@dataclass(frozen=True)
class Layout:
    """A written table in ranges of ``keys`` and ``order``; ``_part`` numbers the ranges.

    ``cuts`` are the keys that more than one part holds: at most one per border between parts.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cuts: DataFrame | None

    def rewritten(self, rows: DataFrame) -> "Layout":
        """The same ranges with other columns, written once."""
        return replace(self, rows=staged(rows))

    def cut_rows(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that belong to a cut key."""
        return rows.limit(0) if self.cuts is None else rows.join(F.broadcast(self.cuts), _same(rows, self.cuts, self.keys), "left_semi")


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Layout:
    """``df`` written once in ranges of ``keys`` and ``order``.

    Part numbers never decrease along the order, and rows equal in keys and order share a part.
    Only a part's first and last key can go on in another part, so two keys per part, which the driver looks at,
    tell which keys are cut.
    """
    ranged = df.repartitionByRange(*keys, *order)
    rows = staged(ranged.withColumn(PART, F.spark_partition_id()))
    if len(keys) == 1:  # plain minima are summed up without a sort; they pass over null, which comes first
        k = F.col(keys[0])
        ends = rows.groupBy(PART).agg(F.min(k).alias("a"), F.max(k).alias("z"), F.max(k.isNull()).alias("_no")).collect()
        held = [set([(r["a"],), (r["z"],)] if r["a"] is not None else []) | ({(None,)} if r["_no"] else set()) for r in ends]
    else:
        row = F.struct(*keys)
        ends = rows.groupBy(PART).agg(F.min(row).alias("a"), F.max(row).alias("z")).collect()
        held = [{tuple(r["a"]), tuple(r["z"])} for r in ends]
    cut = [k for k, n in Counter(k for part in held for k in part).items() if n > 1]
    schema = T.StructType([T.StructField(k, rows.schema[k].dataType) for k in keys])
    return Layout(rows, tuple(keys), tuple(order), _local(rows.sparkSession.createDataFrame(cut, schema)) if cut else None)


def _local(small: DataFrame) -> DataFrame:
    """A small table as part of the plan, so that broadcasting it takes no job."""
    return small.sparkSession.createDataFrame(small.toArrow())


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def _local_aggregates(rows: DataFrame, by: Sequence[str], order: Sequence[str], measures: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """``rows`` with ``_l_<name>`` for every measure, over the rows that are equal in ``by``."""
    inner = Window.partitionBy(*by).orderBy(*order)
    frames = {
        "before": inner.rowsBetween(Window.unboundedPreceding, -1),
        "through": inner.rowsBetween(Window.unboundedPreceding, 0),
        "after": inner.rowsBetween(1, Window.unboundedFollowing),
    }
    return rows.select("*", *[_AGG[k](c).over(frames[f]).alias(f"_l_{n}") for n, (k, c, f) in measures.items()])


def scan(layout: Layout, measures: Mapping[str, tuple[str, str, str]], rows: DataFrame | None = None) -> DataFrame:
    """The layout's rows (or ``rows`` made of them) with running aggregates; ``_part`` stays.

    Rows meet only those of their key and part. What crosses a cut is one row per cut key and part, at most
    two per part: it is computed first, from the cut keys alone, and is broadcast.
    """
    keys, order = list(layout.keys), list(layout.order)
    rows = layout.rows if rows is None else rows
    local = _local_aggregates(rows, [*keys, PART], order, measures)
    carry: dict[str, Column] = {}
    if layout.cuts is not None:
        outer = Window.partitionBy(*keys).orderBy(PART)
        earlier, later = outer.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(1, Window.unboundedFollowing)
        read = rows.select(*dict.fromkeys([*keys, PART, *[c for _, c, _ in measures.values()]]))
        totals = layout.cut_rows(read).groupBy(*keys, PART).agg(*[_AGG[k](c).alias(f"_t_{n}") for n, (k, c, _) in measures.items()])
        carried = totals.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col(PART).alias("_at"),
            *[_AGG[k](f"_t_{n}").over(later if f == "after" else earlier).alias(f"_c_{n}") for n, (k, _, f) in measures.items()],
        )
        on = F.col(PART) == F.col("_at")
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        local = local.join(F.broadcast(_local(carried)), on, "left")
        carry = {n: F.col(f"_c_{n}") for n in measures}
    out = [_combine(k, F.col(f"_l_{n}"), carry.get(n)).alias(n) for n, (k, _, _) in measures.items()]
    return local.select(*rows.columns, *out)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Add running aggregates per ``keys`` along ``order``.

    ``measures`` maps an output name to ``(kind, column, frame)`` with kind sum,
    max or min and frame ``before`` (earlier rows), ``through`` (earlier rows and
    this one) or ``after`` (later rows). A null key is a key of its own.
    """
    return scan(in_parts(df, keys, order), measures).drop(PART)


def running_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Mapping[str, tuple[str, str, str]], sizes: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``running`` for tables that are cheap to derive and whose keys mostly have few rows.

    ``sizes`` holds ``keys`` and ``n_rows``, how many rows a key has (several counts are added). Keys of at most ``hot_rows``
    rows are scanned whole where the join that made ``df`` has put them, without a layout or a further shuffle. The others
    are told by a pass over ``sizes``, fewer than one per ``hot_rows`` rows, and go through ``running``.
    """
    keys = list(keys)

    def whole(rows: DataFrame) -> DataFrame:
        out = [_combine(k, F.col(f"_l_{n}"), None).alias(n) for n, (k, _, _) in measures.items()]
        return _local_aggregates(rows, keys, order, measures).select(*rows.columns, *out)

    found = sizes.groupBy(*keys).agg(F.sum("n_rows").alias("_n")).filter(F.col("_n") > hot_rows).select(*keys).collect()
    if not found:
        return whole(df)
    schema = T.StructType([T.StructField(k, sizes.schema[k].dataType) for k in keys])
    hot = _local(df.sparkSession.createDataFrame(found, schema))
    few = df.join(F.broadcast(hot), _same(df, hot, keys), "left_anti")
    many = df.join(F.broadcast(hot), _same(df, hot, keys), "left_semi")
    return whole(few).unionByName(running(many, keys, order, measures))


def hot_sizes(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``sizes`` for ``running_by_key``, of those keys only that may have more than ``hot_rows`` rows.

    Counts are taken by a hash of the key, so that long keys are not shuffled. ``rows`` is read once for it, and again only where a key is hot.
    """
    h = F.xxhash64(*keys)
    hot = rows.groupBy(h.alias("_h")).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select("_h")
    few = _local(hot)  # fewer than one per ``hot_rows`` rows
    return rows.join(F.broadcast(few), h == few["_h"], "left_semi").groupBy(*keys).agg(F.count("*").alias("n_rows"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """The whole first (or last) row of every key, combined map-side before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    pick = F.max_by if last else F.min_by
    grouped = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return grouped.select(*keys, "_row.*").select(*df.columns)


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: int,
) -> DataFrame:
    """Inner join of closed intervals that overlap inside the same key.

    Both sides are spread over fixed-width bins, so the join is an equi join on
    ``keys`` plus bin; each overlapping pair is kept only in the first bin the two
    share. Column names must not clash except for ``keys``.
    """
    keys = list(keys)

    def binned(df: DataFrame, span: tuple[str, str], tag: str) -> DataFrame:
        lo, hi = (F.floor(F.col(c) / F.lit(width)) for c in span)
        # An interval with no length still owns one bin.
        return df.withColumn(f"_b_{tag}", lo).withColumn(
            "_bin", F.explode(F.sequence(lo, F.greatest(lo, hi)))
        )

    ls, le = left_span
    rs, re_ = right_span
    pairs = binned(left, left_span, "l").join(binned(right, right_span, "r"), [*keys, "_bin"])
    return pairs.filter(
        (F.col(ls) <= F.col(re_))
        & (F.col(le) >= F.col(rs))
        & (F.col("_bin") == F.greatest("_b_l", "_b_r"))
    ).drop("_bin", "_b_l", "_b_r")
