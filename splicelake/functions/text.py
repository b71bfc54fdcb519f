"""Delimited lists, notes and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "; "


def merge_string_set(a: Column, b: Column) -> Column:
    """Union of two delimited lists; a null side leaves the other as it is."""
    union = F.array_sort(F.array_union(F.split(a, SEP), F.split(b, SEP)))
    return F.coalesce(F.array_join(union, SEP), a, b)


def merge_note(a: Column, b: Column) -> Column:
    """Append ``b`` to ``a`` unless one already holds the other, without case."""
    holds = F.contains(F.lower(a), F.lower(b))
    held = F.contains(F.lower(b), F.lower(a))
    return (
        F.when(a.isNull(), b)
        .when(b.isNull() | holds, a)
        .when(held, b)
        .otherwise(F.concat(a, F.lit(SEP), b))
    )


def merge_description(a: Column, b: Column) -> Column:
    return F.nullif(F.concat_ws(SEP, a, b), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def domain_label(name: Column, other_name: Column, ext_id: Column) -> Column:
    return F.coalesce(blank_to_null(name), other_name, ext_id)


def title_symbol(symbol: Column) -> Column:
    """First letter upper, all others lower; unlike initcap, words do not restart it."""
    return F.concat(F.upper(F.substring(symbol, 1, 1)), F.lower(F.substr(symbol, F.lit(2))))


def format_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def locus_text(chromosome: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("chr"), chromosome, F.lit(":"), format_thousands(start), F.lit("-"), format_thousands(end))
