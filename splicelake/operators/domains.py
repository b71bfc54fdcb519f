"""Protein domains against exons, and domains against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import coords, ids, text
from splicelake.operators.grouping import group_opens
from splicelake.operators.lists import group_text, item_rows
from splicelake.operators.ordered import HOT_ROWS, Layout, in_parts, interval_join, running_by_key, scan
from splicelake.session import staged

CODING_BIN = 2048
EVENT_KEYS = ["type_id", "aa_start", "aa_end"]


def with_nuc_span(domains: DataFrame) -> DataFrame:
    return domains.select(
        "*",
        coords.nuc_start(F.col("aa_start")).alias("nuc_start"),
        coords.nuc_end(F.col("aa_end")).alias("nuc_end"),
    ).withColumn("total_length", F.col("nuc_end") - F.col("nuc_start") + 1)


def _coding_exons(cds: DataFrame) -> DataFrame:
    return cds.filter("abs_start_cds > 0").select(
        "tx_key",
        F.col("order_in_transcript").alias("exon_order"),
        "abs_start_cds",
        "abs_end_cds",
        "coding_rank",
    )


def domain_exon_relation(domains: DataFrame, cds: DataFrame) -> DataFrame:
    """Relation of each domain to the exons of its transcript.

    ``complete_exon`` when the exon holding the domain's start also holds its end,
    ``splice_junction`` when not, null when no exon holds the start. The exon is
    found by an equi join on the transcript and a coding-coordinate bin.
    """
    spans = with_nuc_span(domains)
    starts = spans.withColumn("_at", F.col("nuc_start"))
    found = interval_join(
        starts, _coding_exons(cds), ["tx_key"], ("nuc_start", "_at"), ("abs_start_cds", "abs_end_cds"), CODING_BIN
    ).select(
        *spans.columns,
        F.col("exon_order").alias("first_exon"),
        F.col("coding_rank").alias("first_rank"),
        F.when(F.col("nuc_end") <= F.col("abs_end_cds"), F.lit("complete_exon"))
        .otherwise(F.lit("splice_junction"))
        .alias("relation"),
    )
    return found


def unplaced_domains(domains: DataFrame, cds: DataFrame) -> DataFrame:
    """Domains whose start lies in no exon."""
    keys = ["tx_key", *EVENT_KEYS]
    return domains.join(domain_exon_relation(domains, cds).select(*keys).distinct(), keys, "left_anti")


def splice_in_domains(domains: DataFrame, cds: DataFrame, *, count_utr_exons: bool = False) -> DataFrame:
    """One row per exon that a cut domain touches.

    ``included_len`` is negative for the first piece; ``included_abs`` is its
    size. With ``count_utr_exons`` an exon without coding bases that lies between
    the pieces (or behind the last one of a domain that runs past the coding end)
    adds one base, as older tables had it.
    """
    cut = domain_exon_relation(domains, cds).filter(F.col("relation") == "splice_junction").drop("relation")
    pieces = interval_join(
        cut, _coding_exons(cds), ["tx_key"], ("nuc_start", "nuc_end"), ("abs_start_cds", "abs_end_cds"), CODING_BIN
    )
    first = F.col("exon_order") == F.col("first_exon")
    size = (
        F.least("abs_end_cds", "nuc_end") - F.greatest("abs_start_cds", "nuc_start") + 1
    )
    coding = pieces.select(
        *cut.columns,
        "exon_order",
        F.when(first, -size).otherwise(size).alias("included_len"),
        size.alias("included_abs"),
        (F.col("coding_rank") - F.col("first_rank") + 1).cast("int").alias("exon_num_in_domain"),
    )
    if not count_utr_exons:
        return coding.drop("first_rank")
    return _with_utr_pieces(cut, coding, cds).drop("first_rank")


def _with_utr_pieces(cut: DataFrame, coding: DataFrame, cds: DataFrame) -> DataFrame:
    """Add the one-base pieces of non-coding exons and renumber by exon order."""
    last = coding.groupBy("tx_key", *EVENT_KEYS).agg(
        F.max("exon_order").alias("_last"), F.sum("included_abs").alias("_covered")
    )
    ends = cds.groupBy("tx_key").agg(F.max("order_in_transcript").alias("_tx_last"))
    reach = cut.join(last, ["tx_key", *EVENT_KEYS]).join(ends, "tx_key").withColumn(
        "reach_to",
        F.when(F.col("_covered") < F.col("total_length"), F.col("_tx_last")).otherwise(F.col("_last")),
    )
    utr = cds.filter("abs_start_cds = 0").select(
        "tx_key", F.col("order_in_transcript").alias("exon_order"), F.col("order_in_transcript").alias("_eo")
    )
    extra = interval_join(
        reach, utr, ["tx_key"], ("first_exon", "reach_to"), ("exon_order", "_eo"), 64
    ).select(
        *cut.columns,
        "exon_order",
        F.lit(1).cast("bigint").alias("included_len"),
        F.lit(1).cast("bigint").alias("included_abs"),
        F.lit(None).cast("int").alias("exon_num_in_domain"),
    )
    return coding.unionByName(extra).withColumn(
        "exon_num_in_domain", (F.col("exon_order") - F.col("first_exon") + 1).cast("int")
    )


def complete_domain_exon(domains: DataFrame, cds: DataFrame) -> DataFrame:
    """The exon that wholly holds the domain, or -1."""
    placed = domain_exon_relation(domains, cds).select(
        *[F.col(c) for c in domains.columns],
        F.when(F.col("relation") == "complete_exon", F.col("first_exon")).otherwise(-1).alias("exon_order"),
    )
    lost = unplaced_domains(domains, cds).select(*domains.columns, F.lit(-1).alias("exon_order"))
    return placed.unionByName(lost)


def domain_exon_fraction(domains: DataFrame, cds: DataFrame) -> DataFrame:
    """Share of a domain inside each exon and where its junctions fall along it (0 to 1)."""
    spans = with_nuc_span(domains)
    pieces = interval_join(
        spans, _coding_exons(cds), ["tx_key"], ("nuc_start", "nuc_end"), ("abs_start_cds", "abs_end_cds"), CODING_BIN
    )
    extent = (F.col("nuc_end") - F.col("nuc_start")).cast("double")
    size = F.least("abs_end_cds", "nuc_end") - F.greatest("abs_start_cds", "nuc_start") + 1
    return pieces.select(
        *spans.columns,
        "exon_order",
        (size.cast("double") / F.col("total_length").cast("double")).alias("fraction"),
        F.when(
            F.col("abs_end_cds") < F.col("nuc_end"),
            (F.col("abs_end_cds") - F.col("nuc_start")).cast("double") / extent,
        ).alias("junction_at"),
    )


def domain_events(domains: DataFrame, cds: DataFrame, events: str = "all") -> DataFrame:
    """Placed domains with both flags; ``events="cut"`` keeps only domains cut by a junction."""
    placed = domain_exon_relation(domains, cds)
    flagged = placed.withColumn("splice_junction", F.col("relation") == "splice_junction").withColumn(
        "complete_exon", F.col("relation") == "complete_exon"
    )
    return flagged.filter("splice_junction") if events == "cut" else flagged


def collapse_events(events: DataFrame) -> DataFrame:
    """One row per identical event; its accessions become one sorted list."""
    keys = [c for c in events.columns if c != "ext_id"]
    return events.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("ext_id")), "; ").alias("ext_id"))


def merge_domain_lists(a: DataFrame, b: DataFrame, protein: str = "tx_key") -> DataFrame:
    """Union of two domain lists; domains equal in accession, start and end are one."""
    keys = [protein, "ext_id", "aa_start", "aa_end"]
    return a.select(*keys).unionByName(b.select(*keys)).distinct()


def domains_with_fallback(proteins: DataFrame, representative: DataFrame, events: DataFrame) -> DataFrame:
    """Representative domains of a protein, or its plain events when it has none.

    ``proteins`` carries ``tx_key`` and ``protein_interpro_id``; ``events`` is
    keyed by ``tx_key``.
    """
    rep = proteins.filter("protein_interpro_id IS NOT NULL").join(representative, "protein_interpro_id")
    shown = rep.select("tx_key", *rep_domain_columns(), F.lit("representative").alias("origin"))
    covered = rep.select("tx_key").distinct()
    rest = proteins.select("tx_key").join(covered, "tx_key", "left_anti").join(events, "tx_key")
    plain = rest.select(
        "tx_key",
        F.col("type_id").cast("string").alias("type_id"),
        "aa_start",
        "aa_end",
        coords.nuc_start(F.col("aa_start")).alias("nuc_start"),
        coords.nuc_end(F.col("aa_end")).alias("nuc_end"),
        "ext_id",
        F.col("name").alias("name"),
        F.lit("event").alias("origin"),
    )
    return shown.unionByName(plain)


def rep_domain_columns() -> list[Column]:
    return [
        F.col("domain_id").alias("type_id"),
        F.col("start").alias("aa_start"),
        F.col("end").alias("aa_end"),
        ((F.col("start") - 1) * 3 + 1).alias("nuc_start"),
        (F.col("end") * 3).alias("nuc_end"),
        F.col("domain_id").alias("ext_id"),
        text.blank_to_null(F.col("domain_name")).alias("name"),
    ]


def rep_domain_view(representative: DataFrame) -> DataFrame:
    """Representative domains in the shape of plain events."""
    return representative.select("protein_interpro_id", *rep_domain_columns())


#: Order of the domains in a protein's text.
TEXT_ORDER = ("aa_start", "aa_end", "type_id")


def _domain_item() -> Column:
    def clean(c: Column) -> Column:
        return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit(","), F.lit("."))

    def span(lo: str, hi: str) -> Column:
        return F.concat(F.col(lo).cast("string"), F.lit("-"), F.col(hi).cast("string"))

    return F.concat_ws(
        ";",
        clean(F.col("name")),
        clean(F.replace(F.col("ext_id"), F.lit("; "), F.lit("/"))),
        span("aa_start", "aa_end"),
        span("nuc_start", "nuc_end"),
    )


def _named_items(events: DataFrame, types: DataFrame, protein: list[str]) -> DataFrame:
    """Each event's item under its protein, with what it is ordered by."""
    return events.join(types.select("type_id", "name"), "type_id").select(*protein, *TEXT_ORDER, _domain_item().alias("_text"))


def domains_text(events: DataFrame, types: DataFrame, protein: list[str]) -> DataFrame:
    """Per protein ``name;accessions;AAs-AAe;ns-ne`` joined by ``||``, ordered by position. Items are written before they meet."""
    named = staged(_named_items(events, types, protein))
    return group_text(named, protein, F.col("_text"), "||", "domains_info", sort_by=[F.col(c) for c in TEXT_ORDER])


def domain_items(events: DataFrame, types: DataFrame, protein: list[str]) -> DataFrame:
    """The items of ``domains_text`` as rows with their positions; a protein may have any number."""
    return item_rows(_named_items(events, types, protein), protein, F.col("_text"), sort_by=[F.col(c) for c in TEXT_ORDER])


# --- domains against domains -------------------------------------------------


def _distinct_spans(domains: DataFrame) -> DataFrame:
    """Distinct intervals per transcript and how many domains share each; copies collapse map-side."""
    return domains.groupBy("tx_key", "aa_start", "aa_end").agg(F.count("*").alias("n_domains"))


SPAN_ORDER = ["aa_start", "_neg_end"]


def _spans_in_parts(domains: DataFrame) -> Layout:
    """The distinct intervals in ranges of transcript and position, longest first at equal starts."""
    return in_parts(_distinct_spans(domains).withColumn("_neg_end", -F.col("aa_end")), ["tx_key"], SPAN_ORDER)


def _scanned(domains: DataFrame) -> DataFrame:
    return scan(_spans_in_parts(domains), {"_prev_end": ("max", "aa_end", "before"), "_next_start": ("min", "aa_start", "after")})


def overlap_flags(domains: DataFrame) -> DataFrame:
    """Mark each domain that shares a position with another domain of its transcript."""
    flags = _scanned(domains).select(
        "tx_key",
        "aa_start",
        "aa_end",
        (
            (F.col("n_domains") > 1)
            | F.coalesce(F.col("_prev_end") >= F.col("aa_start"), F.lit(False))
            | F.coalesce(F.col("_next_start") <= F.col("aa_end"), F.lit(False))
        ).alias("overlap"),
    )
    return domains.join(flags, ["tx_key", "aa_start", "aa_end"])


def _islands(domains: DataFrame) -> DataFrame:
    """Distinct intervals, still in their parts, with the number of the overlap chain they belong to.

    Two scans over one layout: where a chain opens, and how many have opened so far.
    """
    spans = _spans_in_parts(domains)
    ahead = scan(spans, {"_prev_end": ("max", "aa_end", "before")})
    opens = F.when(F.col("_prev_end") >= F.col("aa_start"), 0).otherwise(1).cast("bigint")
    opened = spans.rewritten(ahead.select("*", opens.alias("_opens")).drop("_prev_end"))
    return scan(opened, {"island": ("sum", "_opens", "through")}).drop("_opens")


def overlap_islands(domains: DataFrame) -> DataFrame:
    """Every domain with its chain of overlapping domains (``island``, 1-based per transcript)."""
    spans = _islands(domains).select("tx_key", "aa_start", "aa_end", "island")
    return domains.join(spans, ["tx_key", "aa_start", "aa_end"])


def overlap_groups(domains: DataFrame) -> DataFrame:
    """Every domain with its chain, the chain's extent and its number of domains."""
    spans = staged(_islands(domains))
    placed = spans.select("tx_key", "aa_start", "aa_end", "island").join(_extents(spans), ["tx_key", "island"])
    return domains.join(placed, ["tx_key", "aa_start", "aa_end"])


def _extents(spans: DataFrame) -> DataFrame:
    return (
        spans.groupBy("tx_key", "island")
        .agg(
            F.min("aa_start").alias("group_start"),
            F.max("aa_end").alias("group_end"),
            F.sum("n_domains").alias("n_domains"),
        )
    )


def close_groups(domains: DataFrame) -> DataFrame:
    """Sequential grouping with a growing extent.

    In order of (start, longest first) a domain joins the open group when one of
    the two holds the other or they share at least half of their joint extent. Equal
    intervals never part. Adds ``island``, the overlap chain, and ``group_at``, the group, both
    numbered from 1 within the transcript; a group never leaves its chain.
    """
    spans = _spans_in_parts(domains)
    seen = scan(spans, {"_prev_end": ("max", "aa_end", "before"), "_prev_start": ("max", "aa_start", "before")}).drop("n_domains")
    opens_chain = F.when(F.col("_prev_end") >= F.col("aa_start"), 0).otherwise(1).cast("bigint")
    chained = spans.rewritten(seen.withColumn("_chain", opens_chain))
    opened = chained.rewritten(group_opens(chained).drop("_prev_end", "_prev_start"))
    numbers = {"island": ("sum", "_chain", "through"), "group_at": ("sum", "_opens", "through")}
    members = scan(opened, numbers).select("tx_key", "aa_start", "aa_end", "island", "group_at")
    return domains.join(members, ["tx_key", "aa_start", "aa_end"])


def group_extents(grouped: DataFrame, keys: list[str]) -> DataFrame:
    return grouped.groupBy(*keys).agg(
        F.min("aa_start").alias("group_start"), F.max("aa_end").alias("group_end"), F.count("*").alias("n_domains")
    )


def group_names(grouped: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Name of each group.

    The name of more than half of its domains. Failing that the longest domain
    whose name is no accession, provided it is at least as long as the group's
    first domain; on equal length the shorter name wins, the first domain's name
    taking part. Otherwise the first domain's name.
    """
    length = F.col("aa_end") - F.col("aa_start")
    per_name = grouped.groupBy(*keys, name).agg(
        F.count("*").alias("_n"),
        F.max(length).alias("_len"),
        F.min(F.struct("aa_start", (-F.col("aa_end")).alias("neg_end"), name)).alias("_first"),
    )
    named = ~ids.looks_like_id(F.col(name))
    totals = per_name.groupBy(*keys).agg(
        F.sum("_n").alias("n_domains"),
        F.max(F.struct("_n", name)).alias("_top"),
        F.min("_first").alias("_first"),
        F.min(
            F.when(named, F.struct((-F.col("_len")).alias("neg_len"), F.length(name).alias("size"), F.col(name)))
        ).alias("_best"),
    )
    first_len = -F.col("_first.neg_end") - F.col("_first.aa_start")
    best_len = -F.col("_best.neg_len")
    first_name, best_name = F.col(f"_first.{name}"), F.col(f"_best.{name}")
    return totals.select(
        *keys,
        "n_domains",
        F.when(F.col("_top._n") * 2 > F.col("n_domains"), F.col(f"_top.{name}"))
        .when(best_len > first_len, best_name)
        .when((best_len == first_len) & (F.length(best_name) < F.length(first_name)), best_name)
        .otherwise(first_name)
        .alias("group_name"),
    )


def max_overlap_depth(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Size of the largest group per transcript."""
    sizes = grouped.groupBy("tx_key", *keys).agg(F.count("*").alias("_n"))
    return sizes.groupBy("tx_key").agg(F.max("_n").alias("max_depth"))


def rank_domains(domains: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``draw_rank`` from 1 within the transcript: longest domain first, ties by position, type and accession.

    Only transcripts of more than ``hot_rows`` domains are laid out in ranges; the others take one shuffle.
    """
    keyed = domains.withColumns({"_neg": F.col("aa_start") - F.col("aa_end"), "_one": F.lit(1).cast("bigint")})
    sizes = domains.groupBy("tx_key").agg(F.count("*").alias("n_rows"))
    order = ["_neg", "aa_start", "type_id", "ext_id"]
    ranked = running_by_key(keyed, ["tx_key"], order, {"draw_rank": ("sum", "_one", "through")}, sizes, hot_rows)
    return ranked.drop("_neg", "_one")
