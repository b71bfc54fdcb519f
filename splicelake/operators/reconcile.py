"""Merging the RefSeq and Ensembl annotation of one species.

Inputs, one row per transcript and keyed by a total order ``ord``:

* RefSeq: ``ord, transcript_refseq_id, own_ensembl_id, gene_geneid_id,
  protein_refseq_id, length, canonical``
* Ensembl: ``ord, transcript_ensembl_id, gene_ensembl_id, protein_ensembl_id,
  length, canonical``; ``protein_ensembl_id`` and ``length`` are null for a
  transcript without a known protein.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splicelake.functions import text
from splicelake.operators import crosswalk as xw
from splicelake.operators.joins import dedupe_transcripts
from splicelake.operators.ordered import first_per_key
from splicelake.session import scratch, staged

COLUMNS = [
    "seq",
    "action",
    "transcript_refseq_id",
    "transcript_ensembl_id",
    "gene_geneid_id",
    "gene_ensembl_id",
    "protein_refseq_id",
    "protein_ensembl_id",
    "canonical",
    "exon_source",
    "ref_tx",
    "ens_tx",
    "ens_prot",
]


def pair_transcripts(refseq: DataFrame, ensembl: DataFrame, rows: DataFrame, trans2pro: DataFrame | None = None) -> DataFrame:
    """Ensembl partner of every RefSeq transcript and what happens to the two.

    Adds ``ens_tx, ens_prot, ens_gene, own_prot, rejected_tx, action`` where
    action is ``merge``, ``separate`` (both are kept), ``fill`` (no partner in the
    Ensembl set: ids come from the crosswalk) or ``alone``.
    """
    proteins = ensembl.filter("protein_ensembl_id IS NOT NULL")
    p2t = proteins.groupBy(F.col("protein_ensembl_id").alias("id")).agg(
        F.max_by("transcript_ensembl_id", "ord").alias("other")
    )
    t2p = ensembl.select(F.col("transcript_ensembl_id").alias("id"), F.struct(F.col("protein_ensembl_id").alias("v")).alias("other"))
    lengths = proteins.groupBy(F.col("protein_ensembl_id").alias("id")).agg(F.max_by("length", "ord").alias("other"))

    x = xw.look_up(refseq, "transcript_refseq_id", xw.transcript_map(rows), "_xw")
    own = F.col("own_ensembl_id")
    x = x.withColumn("_t0", F.coalesce(own, F.col("_xw"))).withColumn(
        "rejected_tx", F.when(own.isNotNull() & (F.col("_xw") != own), F.col("_xw"))
    )
    own_prot = F.nullif(F.col("protein_refseq_id"), F.lit("-"))
    if trans2pro is not None:
        x = xw.look_up(x, "transcript_refseq_id", trans2pro, "_flat").withColumn("own_prot", F.coalesce(own_prot, "_flat")).drop("_flat")
    else:
        x = x.withColumn("own_prot", own_prot)
    x = xw.look_up(x, "own_prot", xw.protein_map(rows), "_p0")
    x = xw.look_up(x, "_p0", p2t, "_t_of_p")
    x = xw.look_up(x, "_t0", t2p, "_p_of_t")
    known_p, known_t = F.col("_t_of_p").isNotNull(), F.col("_p_of_t").isNotNull()
    x = x.withColumn("ens_tx", F.when(~known_t & known_p, F.col("_t_of_p")).otherwise(F.col("_t0"))).withColumn(
        "ens_prot", F.when(known_t & ~known_p, F.col("_p_of_t.v")).otherwise(F.col("_p0"))
    )
    x = x.withColumn("_tx_known", known_t | known_p)
    x = xw.look_up(x, "ens_prot", lengths, "_ens_len")
    x = xw.look_up(x, "gene_geneid_id", xw.gene_map(rows), "ens_gene")
    close = F.abs(F.col("length") - F.col("_ens_len")) <= 1
    action = (
        F.when(F.col("_ens_len").isNotNull() & close, "merge")
        .when(F.col("_ens_len").isNotNull(), "separate")
        .when(~F.col("_tx_known"), "fill")
        .otherwise("alone")
    )
    return x.withColumn("action", action).withColumn(
        "rejected_tx", F.when(F.col("rejected_tx") != F.col("ens_tx"), F.col("rejected_tx"))
    ).drop("_xw", "_t0", "_p0", "_t_of_p", "_p_of_t", "_tx_known", "_ens_len")


def _seq(stage: int, order: Column, step: int) -> Column:
    return F.struct(F.lit(stage).alias("stage"), order.alias("ord"), F.lit(step).alias("step"))


def first_pairing_wins(pairings: DataFrame, ensembl: str, geneid: str, order: str) -> DataFrame:
    """Ensembl gene to the GeneID it was first paired with."""
    return (
        pairings.filter(F.col(ensembl).isNotNull())
        .groupBy(F.col(ensembl).alias("id"))
        .agg(F.min_by(geneid, order).alias("other"))
    )


def repoint_genes(df: DataFrame, canonical: DataFrame) -> DataFrame:
    """Give every row the GeneID its Ensembl gene was first paired with."""
    x = xw.look_up(df, "gene_ensembl_id", canonical, "_canon")
    return x.withColumn("gene_geneid_id", F.coalesce("_canon", "gene_geneid_id")).drop("_canon")


def reconcile_transcripts(
    refseq: DataFrame, ensembl: DataFrame, rows: DataFrame, trans2pro: DataFrame | None = None
) -> DataFrame:
    """One transcript table from both sources.

    ``action`` tells how a row came about: ``merge``, ``separate``, ``fill`` or
    ``alone`` for RefSeq transcripts, ``kept_apart`` for the Ensembl partner of a
    separated one and ``leftover`` for Ensembl transcripts nobody claimed.
    ``exon_source`` names the source whose exons the row takes; ``ref_tx``,
    ``ens_tx`` and ``ens_prot`` are the source records behind it.
    """
    with scratch(rows.sparkSession):  # facts and pairs go when the parts are written
        parts = [staged(part.select(*COLUMNS), kept=True) for part in _reconciled(refseq, ensembl, rows, trans2pro)]
    everything = reduce(DataFrame.unionByName, parts)
    unique = dedupe_transcripts(everything, "seq")
    return repoint_genes(unique, first_pairing_wins(everything, "gene_ensembl_id", "gene_geneid_id", "seq"))


def _reconciled(refseq: DataFrame, ensembl: DataFrame, rows: DataFrame, trans2pro: DataFrame | None) -> Iterator[DataFrame]:
    """The rows of both sources before ids are made unique: RefSeq's, Ensembl partners kept apart, Ensembl's leftovers.

    One after the other, so that the shuffles of each can go before the next is made.
    """
    pairs = staged(pair_transcripts(refseq, ensembl, rows, trans2pro))
    facts = xw.crosswalk_facts(rows)
    e = ensembl.select(
        F.col("ord").alias("_e_ord"),
        F.col("transcript_ensembl_id").alias("_e_tx"),
        F.col("gene_ensembl_id").alias("_e_gene"),
        F.col("protein_ensembl_id").alias("_e_prot"),
        F.col("canonical").alias("_e_canonical"),
    )
    partnered = pairs.join(e, F.col("ens_tx") == F.col("_e_tx"), "left")
    merged = F.col("action") == "merge"
    from_refseq = partnered.select(
        _seq(0, F.col("ord"), 0).alias("seq"),
        "action",
        "transcript_refseq_id",
        F.when(merged, F.coalesce("own_ensembl_id", "ens_tx")).otherwise(F.col("own_ensembl_id")).alias("transcript_ensembl_id"),
        "gene_geneid_id",
        F.col("ens_gene").alias("gene_ensembl_id"),
        F.col("own_prot").alias("protein_refseq_id"),
        F.lit(None).cast("string").alias("protein_ensembl_id"),
        F.when(merged, F.col("canonical").bitwiseOR(F.coalesce("_e_canonical", F.lit(0)))).otherwise(F.col("canonical")).alias("canonical"),
        F.when(merged & F.col("_e_tx").isNotNull(), "ensembl").otherwise("refseq").alias("exon_source"),
        F.col("transcript_refseq_id").alias("ref_tx"),
        F.when(merged, F.col("_e_tx")).alias("ens_tx"),
        F.when(merged, F.col("ens_prot")).alias("ens_prot"),
    )
    from_refseq = staged(from_refseq)  # every way of filling ids reads it
    filled = from_refseq.filter("action IN ('merge', 'fill')")
    yield from_refseq.filter("action NOT IN ('merge', 'fill')").unionByName(xw.fill_missing_ids(filled, facts))

    apart = partnered.filter((F.col("action") == "separate") & F.col("_e_tx").isNotNull()).select(
        _seq(0, F.col("ord"), 1).alias("seq"),
        F.lit("kept_apart").alias("action"),
        F.lit(None).cast("string").alias("transcript_refseq_id"),
        F.col("_e_tx").alias("transcript_ensembl_id"),
        F.lit(None).cast("string").alias("gene_geneid_id"),
        F.col("_e_gene").alias("gene_ensembl_id"),
        F.lit(None).cast("string").alias("protein_refseq_id"),
        F.col("_e_prot").alias("protein_ensembl_id"),
        F.col("_e_canonical").alias("canonical"),
        F.lit("ensembl").alias("exon_source"),
        F.lit(None).cast("string").alias("ref_tx"),
        F.col("_e_tx").alias("ens_tx"),
        F.col("_e_prot").alias("ens_prot"),
    )
    apart = first_per_key(apart, ["transcript_ensembl_id"], ["seq"])
    yield xw.look_up(apart, "gene_ensembl_id", xw.gene_map(rows), "_g").withColumn("gene_geneid_id", F.col("_g")).drop("_g")

    written = (
        pairs.select(F.explode(F.array(F.when(F.col("action").isin("merge", "separate"), F.col("ens_tx")), F.col("rejected_tx"))).alias("_e_tx"))
        .filter("_e_tx IS NOT NULL")
        .distinct()
    )
    left = e.join(written, "_e_tx", "left_anti").select(
        _seq(1, F.col("_e_ord"), 0).alias("seq"),
        F.lit("leftover").alias("action"),
        F.lit(None).cast("string").alias("transcript_refseq_id"),
        F.col("_e_tx").alias("transcript_ensembl_id"),
        F.lit(None).cast("string").alias("gene_geneid_id"),
        F.col("_e_gene").alias("gene_ensembl_id"),
        F.lit(None).cast("string").alias("protein_refseq_id"),
        F.col("_e_prot").alias("protein_ensembl_id"),
        F.col("_e_canonical").alias("canonical"),
        F.lit("ensembl").alias("exon_source"),
        F.lit(None).cast("string").alias("ref_tx"),
        F.col("_e_tx").alias("ens_tx"),
        F.col("_e_prot").alias("ens_prot"),
    )
    left = xw.fill_missing_ids(staged(left), facts)
    ref_canonical = refseq.groupBy(F.col("transcript_refseq_id").alias("id")).agg(F.max("canonical").alias("other"))
    yield xw.look_up(left, "transcript_refseq_id", ref_canonical, "_rc").withColumn(
        "canonical", F.col("canonical").bitwiseOR(F.coalesce("_rc", F.lit(0)))
    ).drop("_rc")


def reconcile_metrics(refseq: DataFrame, ensembl: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts that tell how well the two sources agree."""
    pairs = pair_transcripts(refseq, ensembl, rows)
    tagged = xw.look_up(pairs, "transcript_refseq_id", xw.transcript_map(rows), "_xw")
    both = F.col("own_ensembl_id").isNotNull() & F.col("_xw").isNotNull()
    count = lambda c: F.count_if(c).cast("bigint")
    return tagged.agg(
        count(both & (F.col("own_ensembl_id") == F.col("_xw"))).alias("id_matches"),
        count(both & (F.col("own_ensembl_id") != F.col("_xw"))).alias("id_mismatches"),
        count(F.col("action") == "merge").alias("merged_pairs"),
        count(F.col("action") == "separate").alias("separated_pairs"),
        count(F.col("action") == "fill").alias("filled"),
        count(F.col("action") == "alone").alias("alone"),
    )


def merge_genes(refseq: DataFrame, ensembl: DataFrame) -> DataFrame:
    """Full outer merge of two gene tables on ``gene_ensembl_id``.

    Nulls are filled from the other side; the other side's synonyms and symbol
    join the synonyms unless they are the gene's own symbol.
    """
    attributes = ["gene_geneid_id", "gene_symbol", "synonyms", "chromosome", "strand"]
    b = ensembl.select("gene_ensembl_id", *[F.col(c).alias(f"_b_{c}") for c in attributes], F.lit(True).alias("_b"))
    keyless = refseq.filter("gene_ensembl_id IS NULL")
    x = refseq.filter("gene_ensembl_id IS NOT NULL").withColumn("_a", F.lit(True)).join(b, "gene_ensembl_id", "full_outer")
    own = F.coalesce(F.split("synonyms", text.SEP), F.array().cast("array<string>"))
    other = F.concat(
        F.coalesce(F.split("_b_synonyms", text.SEP), F.array().cast("array<string>")), F.array("_b_gene_symbol")
    )
    symbol = F.coalesce("gene_symbol", "_b_gene_symbol")
    added = F.filter(F.array_except(other, own), lambda s: s.isNotNull() & (s != symbol))
    joined = F.nullif(F.array_join(F.array_sort(F.array_union(own, added)), text.SEP), F.lit(""))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    merged = x.select(
        F.coalesce("gene_geneid_id", "_b_gene_geneid_id").alias("gene_geneid_id"),
        "gene_ensembl_id",
        symbol.alias("gene_symbol"),
        F.when(both, joined).otherwise(F.coalesce("synonyms", "_b_synonyms")).alias("synonyms"),
        F.coalesce("chromosome", "_b_chromosome").alias("chromosome"),
        F.coalesce("strand", "_b_strand").alias("strand"),
    )
    return merged.unionByName(keyless.select(*merged.columns))


def recover_missing_genes(transcripts: DataFrame, merged: DataFrame, *sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genes for every transcript: the merged table first, then each source table.

    Returns (genes, transcripts still without a gene). The second must be empty.
    """
    columns = ["gene_geneid_id", "gene_ensembl_id", "gene_symbol", "synonyms", "chromosome", "strand"]
    found = merged.select(*columns)
    missing = transcripts.select("gene_geneid_id", "gene_ensembl_id").distinct()

    def without(need: DataFrame, have: DataFrame) -> DataFrame:
        for key in ("gene_geneid_id", "gene_ensembl_id"):
            need = need.join(have.select(key).filter(F.col(key).isNotNull()), key, "left_anti").select(
                "gene_geneid_id", "gene_ensembl_id"
            )
        return need

    missing = without(missing, found)
    for source in sources:
        offered = source.select(*columns)
        by_id = offered.join(missing.select("gene_geneid_id"), "gene_geneid_id", "left_semi").unionByName(
            offered.join(missing.select("gene_ensembl_id"), "gene_ensembl_id", "left_semi")
        )
        found = found.unionByName(by_id.distinct().select(*columns))
        missing = without(missing, offered)
    return found, missing


def merge_canonical(a: Column, b: Column) -> Column:
    """0 none, 1 RefSeq, 2 Ensembl, 3 both: the flags combine bit by bit."""
    return a.bitwiseOR(b)


def same_exons(pairs: DataFrame, exons: DataFrame, key: str = "tx_key") -> DataFrame:
    """Add ``same_exons`` to transcript pairs (a_tx, b_tx): equal exon lists in equal order.

    Exons meet by position, so a list is never collected.
    """
    place = ["order_in_transcript", "genomic_start_tx", "genomic_end_tx"]
    sizes = exons.groupBy(key).agg(F.count("*").alias("_n"))
    met = (
        pairs.select("a_tx", "b_tx")
        .join(exons.select(F.col(key).alias("a_tx"), *place), "a_tx")
        .join(exons.select(F.col(key).alias("b_tx"), *place), ["b_tx", *place])
        .groupBy("a_tx", "b_tx")
        .agg(F.count("*").alias("_met"))
    )
    x = pairs.join(met, ["a_tx", "b_tx"], "left")
    for tag in ("a", "b"):
        x = x.join(sizes.select(F.col(key).alias(f"{tag}_tx"), F.col("_n").alias(f"_n{tag}")), f"{tag}_tx", "left")
    n_met, n_a, n_b = (F.coalesce(c, F.lit(0)) for c in ("_met", "_na", "_nb"))
    return x.withColumn("same_exons", (n_met == n_a) & (n_met == n_b)).drop("_met", "_na", "_nb")


def same_transcript(
    refseq: tuple[str, str], ensembl: tuple[str, str], strand: tuple[str, str], exons_equal: str = "same_exons"
) -> Column:
    """Equality by the first id kind both have, else by strand and exon list."""
    r1, r2 = (F.col(c) for c in refseq)
    e1, e2 = (F.col(c) for c in ensembl)
    return (
        F.when(r1.isNotNull() & r2.isNotNull(), r1 == r2)
        .when(e1.isNotNull() & e2.isNotNull(), e1 == e2)
        .otherwise((F.col(strand[0]) == F.col(strand[1])) & F.col(exons_equal))
    )


def same_gene(geneid: tuple[str, str], ensembl: tuple[str, str]) -> Column:
    """Genes are equal when both ids are, or when one kind is equal and the other is missing on a side."""
    g1, g2 = (F.col(c) for c in geneid)
    e1, e2 = (F.col(c) for c in ensembl)
    g, e = g1.eqNullSafe(g2), e1.eqNullSafe(e2)
    return (g & e) | ((g1.isNull() | g2.isNull()) & e) | ((e1.isNull() | e2.isNull()) & g)
