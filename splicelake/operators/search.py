"""Gene search for a batch of terms, gene documents and views of transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions import ids, text
from splicelake.operators.exons import coding_transcripts
from splicelake.operators.joins import or_join
from splicelake.operators.lists import group_text, item_rows
from splicelake.operators.ordered import running
from splicelake.session import scratch, staged, staged_for_good

TRANSCRIPT_ID_COLUMNS = (
    "transcript_refseq_id",
    "transcript_ensembl_id",
    "protein_refseq_id",
    "protein_ensembl_id",
)
VERSION_CUT = "."


def _gene_keys(genes: DataFrame) -> DataFrame:
    """(key, gene_key, specie) for symbol, GeneID and Ensembl gene, upper-cased."""
    keyed = genes.select(
        F.explode(F.array_distinct(F.array(*[F.upper(c) for c in ("gene_symbol", "gene_geneid_id", "gene_ensembl_id")]))).alias("key"),
        "gene_key",
        "specie",
    )
    return keyed.filter("key IS NOT NULL")


def _transcript_keys(transcripts: DataFrame) -> DataFrame:
    """(key, gene ids) for the four transcript and protein ids."""
    return (
        transcripts.select(
            F.explode(F.array_distinct(F.array(*[F.upper(c) for c in TRANSCRIPT_ID_COLUMNS]))).alias("key"),
            F.col("gene_geneid_id").alias("_t_geneid"),
            F.col("gene_ensembl_id").alias("_t_ensembl"),
        )
        .filter("key IS NOT NULL")
    )


def _genes_of(hits: DataFrame, genes: DataFrame) -> DataFrame:
    g = genes.select("gene_key", "specie", "gene_geneid_id", "gene_ensembl_id")
    return (
        or_join(hits, g, ("_t_geneid", "gene_geneid_id"), ("_t_ensembl", "gene_ensembl_id"))
        .select("term", "tier", "gene_key", "specie")
        .distinct()
    )


def _synonym_hits(terms: DataFrame, genes: DataFrame) -> DataFrame:
    names = genes.select(
        F.explode(F.array_distinct(F.split(F.lower("synonyms"), text.SEP))).alias("key"), "gene_key", "specie", "gene_symbol"
    )
    return terms.withColumn("key", F.lower("term")).join(names, "key").drop("key")


def _best_tier(hits: DataFrame) -> DataFrame:
    """The hits of each term's first tier; ``hits`` is read twice and so has to be written."""
    best = hits.groupBy("term").agg(F.min("tier").alias("_best"))
    return hits.join(best, "term").filter("tier = _best").drop("_best")


def _exact_hits(terms: DataFrame, genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """All hits of the three exact tiers.

    The third tier compares ids without version as a literal prefix: a term
    matches an id that starts with it. Stored ids are cut to the lengths of the
    terms that begin with the same character, which makes it an equi join; these
    lengths are a scalar subquery, bounded by characters times id lengths.
    """
    asked = terms.select("term", F.upper("term").alias("key")).distinct()
    tier1 = asked.join(_gene_keys(genes), "key").select("term", F.lit(1).alias("tier"), "gene_key", "specie")
    tier2 = asked.join(_transcript_keys(transcripts), "key").select(
        "term", F.lit(2).alias("tier"), "_t_geneid", "_t_ensembl"
    )
    bare = asked.select("term", F.substring_index("key", VERSION_CUT, 1).alias("key")).filter("key <> ''")
    stored = _transcript_keys(transcripts).withColumnRenamed("key", "full")
    first = bare.select(F.substring("key", 1, 1).alias("c"), F.length("key").alias("n"))
    per_first = first.groupBy("c").agg(F.collect_set("n").alias("ns"))
    by_first = per_first.agg(F.map_from_entries(F.collect_list(F.struct("c", "ns")))).scalar()
    sizes = F.try_element_at(by_first, F.substring("full", 1, 1))
    sized = stored.withColumn("n", F.explode(sizes)).filter(F.col("n") <= F.length(ids.strip_version(F.col("full"))))
    prefixes = sized.select(F.substring("full", F.lit(1), F.col("n")).alias("key"), "_t_geneid", "_t_ensembl")
    tier3 = bare.join(prefixes, "key").select("term", F.lit(3).alias("tier"), "_t_geneid", "_t_ensembl")
    # Ids and prefixes are looked up one after the other, so the shuffles of one are gone before the other's are made.
    found = reduce(DataFrame.unionByName, [staged(tier.distinct()) for tier in (tier2, tier3)])
    by_transcript = _genes_of(found, genes)  # read twice, found once; a row names its tier, so no two are equal
    return tier1.unionByName(by_transcript)


def find_genes(terms: DataFrame, genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(term, tier, gene_key, specie): genes of the first tier that has any hit."""
    with scratch(terms.sparkSession):
        hits = staged_for_good(_exact_hits(terms, genes, transcripts))
    return _best_tier(hits)


def close_genes(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes with the term among their synonyms, without case."""
    return _synonym_hits(terms.select("term").distinct(), genes).select("term", "gene_key", "specie", "gene_symbol")


def search(
    terms: DataFrame, genes: DataFrame, transcripts: DataFrame, *, species_first: bool = False
) -> DataFrame:
    """Exact tiers, then synonyms (``is_exact`` false), then the species filter.

    ``terms`` may carry a ``species`` column; null or ``all`` keeps every species.
    By default the filter follows the choice of the tier, so a hit in another
    species hides later tiers; ``species_first`` filters before it.
    """
    narrowed = species_first and "species" in terms.columns
    wanted = F.col("species").isNull() | (F.col("species") == "all") | (F.col("specie") == F.col("species"))
    with scratch(terms.sparkSession):
        hits = _exact_hits(terms, genes, transcripts).unionByName(
            close_genes(terms, genes).select("term", F.lit(4).alias("tier"), "gene_key", "specie")
        )
        if narrowed:
            hits = hits.join(terms.select("term", "species").distinct(), "term").filter(wanted)
        hits = staged_for_good(hits)
    if narrowed:
        best = hits.groupBy("term", "species").agg(F.min("tier").alias("_best"))
        chosen = hits.join(
            best.withColumnsRenamed({"term": "_bt", "species": "_bs"}),
            (F.col("term") == F.col("_bt")) & F.col("species").eqNullSafe(F.col("_bs")),
        ).filter("tier = _best").drop("_best", "_bt", "_bs")
    else:
        chosen = _best_tier(hits)
        if "species" in terms.columns:
            chosen = chosen.join(terms.select("term", "species").distinct(), "term").filter(wanted)
    return chosen.withColumn("is_exact", F.col("tier") < 4)


def did_you_mean(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """Candidate symbols of every term that is a synonym of more than one gene."""
    hits = close_genes(terms, genes)
    several = hits.groupBy("term").agg(F.count("*").alias("n_genes")).filter("n_genes > 1")
    listed = group_text(
        hits.join(several, "term"), ["term", "n_genes"], F.col("gene_symbol"), ", ", "symbols", unique=True
    )
    return listed


def did_you_mean_items(terms: DataFrame, genes: DataFrame) -> DataFrame:
    """The candidates of ``did_you_mean`` as rows ``term, n_genes, position, item``, however many a term has."""
    hits = close_genes(terms, genes)
    several = hits.groupBy("term").agg(F.count("*").alias("n_genes")).filter("n_genes > 1")
    listed = item_rows(hits.join(several, "term").select("term", "gene_symbol"), ["term"], F.col("gene_symbol"), unique=True)
    return listed.join(several, "term").select("term", "n_genes", "position", "item")


# --- documents ---------------------------------------------------------------


def document_counts(
    genes: DataFrame, transcripts: DataFrame, cds: DataFrame, proteins: DataFrame, domains: DataFrame
) -> DataFrame:
    """Flat shape of every gene document: how many of each child it holds."""
    def per_gene(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("gene_key").agg(F.count("*").alias(out))

    owners = transcripts.select("tx_key", "gene_key")
    parts = [
        per_gene(transcripts, "n_transcripts"),
        per_gene(cds, "n_transcript_exons"),
        per_gene(cds.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct(), "n_gene_exons"),
        per_gene(proteins, "n_proteins"),
        per_gene(domains.join(owners, "tx_key"), "n_domains"),
    ]
    out = genes.select("gene_key", "gene_symbol", "specie")
    for p in parts:
        out = out.join(p, "gene_key", "left")
    return out.na.fill(0, [c for c in out.columns if c.startswith("n_")])


def gene_exons(cds: DataFrame) -> DataFrame:
    """The distinct exons of every gene, one row each."""
    return cds.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct()


LISTS = ("exons", "domains")


def _with_children(rows: DataFrame, cds: DataFrame, proteins: DataFrame, domains: DataFrame) -> DataFrame:
    """``rows`` with the protein of their transcript, its exons in order and its domains by position; lists are empty where there are none."""
    exons = cds.groupBy("tx_key").agg(
        F.array_sort(
            F.collect_list(
                F.struct("order_in_transcript", "genomic_start_tx", "genomic_end_tx", "abs_start_cds", "abs_end_cds")
            )
        ).alias("exons")
    )
    placed = domains.groupBy("tx_key").agg(
        F.array_sort(F.collect_list(F.struct("aa_start", "aa_end", "type_id", "ext_id", "name"))).alias("domains")
    )
    protein = proteins.select(
        "tx_key", F.struct("protein_refseq_id", "protein_ensembl_id", "description", "length").alias("protein")
    )
    for children in (protein, exons, placed):
        rows = rows.join(children, "tx_key", "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.array()) for c in LISTS})


def _body(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("gene_key", "tx_key", *TRANSCRIPT_ID_COLUMNS, "tx_start", "tx_end", "canonical")


def transcript_documents(transcripts: DataFrame, cds: DataFrame, proteins: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per transcript with its protein, exons in order and domains by position.

    A transcript without exons or domains has empty lists, one without protein a null.
    """
    return _with_children(_body(transcripts), cds, proteins, domains)


def gene_document(genes: DataFrame, transcripts: DataFrame, cds: DataFrame, proteins: DataFrame, domains: DataFrame) -> DataFrame:
    """Gene documents, one row per transcript with its gene's columns beside it.

    The layout is the same for every size, so a gene of very many transcripts is never one row. A
    gene without transcripts has one row with a null ``tx_key``. ``gene_exons`` lists the exons of
    the gene as a whole. Gene and transcript meet before the lists are there, which so are dealt once, by transcript.
    """
    head = ["gene_key", "gene_geneid_id", "gene_ensembl_id", "gene_symbol", "synonyms", "chromosome", "strand", "specie"]
    heads = genes.select(*head)
    found = _with_children(heads.join(_body(transcripts), "gene_key"), cds, proteins, domains)
    columns = [*head, *[c for c in found.columns if c not in head]]
    bare = heads.join(transcripts.select("gene_key"), "gene_key", "left_anti")
    missing = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in columns if c not in head]
    return found.select(*columns).unionByName(bare.select(*head, *missing))


def transcript_view(transcripts: DataFrame, proteins: DataFrame, *, reviewed_only: bool = False) -> DataFrame:
    """Coding transcripts as listed for a gene: names, lengths in nucleotides, display order."""
    shown = coding_transcripts(transcripts, reviewed_only=reviewed_only)
    lengths = proteins.select("tx_key", F.col("length").alias("protein_length"))
    rows = shown.join(lengths, "tx_key", "left").select(
        "gene_key",
        "tx_key",
        ids.display_name(F.col("transcript_refseq_id"), F.col("transcript_ensembl_id")).alias("transcript_name"),
        ids.display_name(F.col("protein_refseq_id"), F.col("protein_ensembl_id")).alias("protein_name"),
        (F.col("protein_length") * 3).alias("protein_nt"),
        "canonical",
    )
    return rank_transcripts(rows)


def rank_transcripts(rows: DataFrame, length: str = "protein_nt") -> DataFrame:
    """Canonical first, then the longest protein; ties in key order."""
    keyed = rows.withColumn("_plain", F.when(F.col("canonical") != 0, 0).otherwise(1)).withColumn(
        "_neg", -F.coalesce(F.col(length), F.lit(0))
    ).withColumn("_one", F.lit(1).cast("bigint"))
    return running(
        keyed,
        ["gene_key"],
        ["_plain", "_neg", "tx_key"],
        {"display_rank": ("sum", "_one", "through")},
    ).drop("_plain", "_neg", "_one")
