"""Content reports and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators import domains as dom
from splicelake.operators import stats
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query
from splicelake.sinks.tables import export_gene_summary_csv
from splicelake.sources.checks import read_result_csv


def _exons_with_ids(t: Tables) -> DataFrame:
    ids = t.genes.select("gene_key", "gene_geneid_id", "gene_ensembl_id")
    return t.exons.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct().join(ids, "gene_key")


@query(
    "gene_summary",
    """SELECT g.gene_key, gene_symbol, count(*) AS transcripts_number, max(CAST(exon_count AS BIGINT)) AS max_exons_per_transcript, any_value(n) AS unique_exons_per_gene
       FROM genes g JOIN transcripts t ON g.gene_key = t.gene_key
       JOIN (SELECT gene_key, count(*) AS n FROM (SELECT DISTINCT gene_key, genomic_start_tx, genomic_end_tx FROM exons) GROUP BY 1) u ON u.gene_key = g.gene_key
       GROUP BY g.gene_key, gene_symbol""",
)
def gene_summary(t: Tables) -> DataFrame:
    unique = t.exons.select("gene_key", "genomic_start_tx", "genomic_end_tx").distinct()
    return stats.gene_summary(t.genes, t.transcripts, unique)


@query(
    "export_gene_summary",
    """WITH s AS (SELECT g.gene_key, gene_symbol, specie, count(*) AS transcripts_number, max(CAST(exon_count AS BIGINT)) AS max_exons_per_transcript, any_value(n) AS unique_exons_per_gene
         FROM genes g JOIN transcripts t ON g.gene_key = t.gene_key
         JOIN (SELECT gene_key, count(*) AS n FROM (SELECT DISTINCT gene_key, genomic_start_tx, genomic_end_tx FROM exons) GROUP BY 1) u ON u.gene_key = g.gene_key GROUP BY ALL)
       SELECT 'all' AS layout, * FROM s UNION ALL SELECT 'by species', * FROM s""",
)
def export_gene_summary(t: Tables) -> DataFrame:
    """The gene summary written as CSV in both layouts and read back from them."""
    folder = t.folder("export", uuid.uuid4().hex)
    summary = gene_summary(t).join(t.genes.select("gene_key", "specie"), "gene_key")
    export_gene_summary_csv(summary, folder)
    schema = "gene_key LONG, gene_symbol STRING, transcripts_number LONG, max_exons_per_transcript LONG, unique_exons_per_gene LONG, specie STRING"
    whole = read_result_csv(t.spark, f"{folder}/gene_summary", schema).withColumn("layout", F.lit("all"))
    parted = read_result_csv(t.spark, f"{folder}/gene_summary_by_species", schema).withColumn("layout", F.lit("by species"))
    return whole.unionByName(parted)


@query(
    "species_counts",
    """WITH u AS (SELECT DISTINCT gene_key, genomic_start_tx AS s, genomic_end_tx AS e FROM exons), ux AS (SELECT u.*, gene_geneid_id AS a, gene_ensembl_id AS b FROM u JOIN genes g ON g.gene_key = u.gene_key)
       SELECT specie, count(*) AS genes,
       (SELECT count(*) FROM (SELECT transcript_refseq_id, transcript_ensembl_id FROM transcripts t JOIN genes x ON t.gene_ensembl_id = x.gene_ensembl_id WHERE x.specie = g.specie
          UNION SELECT transcript_refseq_id, transcript_ensembl_id FROM transcripts t JOIN genes x ON t.gene_geneid_id = x.gene_geneid_id WHERE x.specie = g.specie)) AS transcripts,
       (SELECT count(*) FROM (SELECT a, b, s, e FROM ux JOIN genes x ON a = x.gene_geneid_id WHERE x.specie = g.specie
          UNION SELECT a, b, s, e FROM ux JOIN genes x ON b = x.gene_ensembl_id WHERE x.specie = g.specie)) AS unique_exons
       FROM genes g GROUP BY specie""",
)
def species_counts(t: Tables) -> DataFrame:
    return stats.species_counts(t.genes, t.transcripts, _exons_with_ids(t))


@query(
    "union_ids_by_species",
    """SELECT specie, gene_geneid_id AS id FROM genes WHERE gene_geneid_id IS NOT NULL UNION SELECT specie, gene_ensembl_id FROM genes WHERE gene_ensembl_id IS NOT NULL""",
)
def union_ids_by_species(t: Tables) -> DataFrame:
    return stats.union_ids_by_species(t.genes)


@query(
    "species_domain_stats",
    """WITH own AS (SELECT DISTINCT tx_key, specie, protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL AS coding
         FROM transcripts t JOIN genes g ON t.gene_geneid_id = g.gene_geneid_id OR t.gene_ensembl_id = g.gene_ensembl_id)
       SELECT specie, count(DISTINCT type_id) AS domain_types, count(*) AS domain_events,
         (SELECT count(*) FROM pieces p JOIN own o ON p.tx_key = o.tx_key WHERE o.specie = own.specie) AS in_domain_junctions
       FROM relation r JOIN own ON r.tx_key = own.tx_key WHERE coding GROUP BY specie""",
)
def species_domain_stats(t: Tables) -> DataFrame:
    events = dom.domain_events(t.domains, t.cds)
    return stats.species_domain_stats(t.genes, t.transcripts, events, dom.splice_in_domains(t.domains, t.cds))


@query("gene_extent", "SELECT gene_key, min(tx_start) AS gene_start, max(tx_end) AS gene_end FROM transcripts GROUP BY 1")
def gene_extent(t: Tables) -> DataFrame:
    return stats.gene_extent(t.transcripts)


@query("max_protein_nt", "SELECT gene_key, max(length) * 3 AS max_protein_nt FROM proteins GROUP BY 1")
def max_protein_nt(t: Tables) -> DataFrame:
    return stats.max_protein_nt(t.proteins)


@query(
    "hist_exon_count",
    """WITH h AS (SELECT CASE WHEN exon_count <= 5 THEN CAST(exon_count AS VARCHAR) WHEN exon_count <= 9 THEN '6-9' WHEN exon_count <= 15 THEN '10-15'
         WHEN exon_count <= 35 THEN '16-35' ELSE '36+' END AS bucket, count(transcript_refseq_id) AS n FROM transcripts GROUP BY 1)
       SELECT bucket, n FROM h UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM h""",
)
def hist_exon_count(t: Tables) -> DataFrame:
    return stats.exon_count_histogram(t.transcripts)


COUNT_CASE = """CASE WHEN k <= 5 THEN CAST(k AS VARCHAR) WHEN k <= 15 THEN '6-15' WHEN k <= 35 THEN '16-35' ELSE '36+' END"""


@query(
    "hist_transcripts_per_gene",
    f"""WITH h AS (SELECT {COUNT_CASE} AS bucket, count(*) AS n FROM (SELECT gene_geneid_id, count(transcript_refseq_id) AS k FROM transcripts GROUP BY 1) GROUP BY 1)
       SELECT bucket, n FROM h UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM h""",
)
def hist_transcripts_per_gene(t: Tables) -> DataFrame:
    return stats.transcripts_per_gene_histogram(t.transcripts)


@query(
    "hist_events_per_type",
    f"""WITH h AS (SELECT {COUNT_CASE} AS bucket, count(*) AS n FROM (SELECT type_id, count(*) AS k FROM relation GROUP BY 1) GROUP BY 1)
       SELECT bucket, n FROM h UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM h""",
)
def hist_events_per_type(t: Tables) -> DataFrame:
    return stats.events_per_type_histogram(dom.domain_events(t.domains, t.cds))


@query(
    "domain_size_hist",
    """WITH h AS (SELECT CASE WHEN total_length <= 60 THEN '0-60' WHEN total_length <= 120 THEN '61-120' WHEN total_length <= 300 THEN '121-300' WHEN total_length <= 900 THEN '301-900'
         ELSE '901+' END AS bucket, count(*) AS n FROM spans GROUP BY 1) SELECT bucket, n FROM h UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM h""",
)
def domain_size_hist(t: Tables) -> DataFrame:
    return stats.domain_size_histogram(dom.with_nuc_span(t.domains))


@query(
    "check_spans",
    """SELECT count(*) FILTER (tx_start + 3 >= tx_end) AS short_tx, count(*) FILTER (cds_start + 3 >= cds_end) AS short_cds,
       count(*) FILTER (tx_start + 3 >= cds_start) AS short_utr_start, count(*) FILTER (tx_end + 3 <= cds_end) AS cds_past_end FROM transcripts""",
)
def check_spans(t: Tables) -> DataFrame:
    return stats.check_spans(t.transcripts)


@query(
    "small_exons",
    """SELECT count(*) FILTER (n <= 0) AS size_0_or_less, count(*) FILTER (n = 1) AS size_1, count(*) FILTER (n = 2) AS size_2, count(*) FILTER (n = 3) AS size_3,
       count(*) FILTER (n = 4) AS size_4 FROM (SELECT abs_end_cds - abs_start_cds AS n FROM cds)""",
)
def small_exons(t: Tables) -> DataFrame:
    """Coding lengths instead of genomic ones, which are never small here."""
    return stats.small_exons(
        t.cds.select(F.col("abs_start_cds").alias("genomic_start_tx"), F.col("abs_end_cds").alias("genomic_end_tx"))
    )


@query(
    "small_proteins",
    """SELECT count(*) FILTER (length <= 0) AS size_0_or_less, count(*) FILTER (length = 1) AS size_1, count(*) FILTER (length = 2) AS size_2, count(*) FILTER (length = 3) AS size_3,
       count(*) FILTER (length = 4) AS size_4, count(*) FILTER (length BETWEEN 5 AND 60) AS size_5_to_60 FROM proteins""",
)
def small_proteins(t: Tables) -> DataFrame:
    return stats.small_proteins(t.proteins)


@query(
    "type_cut_counts",
    """SELECT d.type_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT type_id FROM domains) d LEFT JOIN (SELECT type_id, count(*) AS n FROM pieces GROUP BY 1) p ON d.type_id = p.type_id""",
)
def type_cut_counts(t: Tables) -> DataFrame:
    return stats.type_cut_counts(t.domains.select("type_id").distinct(), dom.splice_in_domains(t.domains, t.cds))


@query(
    "domain_coverage",
    """SELECT p.tx_key, length, CAST(sum(aa_end) - sum(aa_start) AS BIGINT) AS domain_space FROM proteins p JOIN domains d ON p.tx_key = d.tx_key GROUP BY p.tx_key, length""",
)
def domain_coverage(t: Tables) -> DataFrame:
    return stats.domain_coverage(t.proteins, t.domains)


@query(
    "longest_genes",
    """SELECT gene_key, max(tx_end) - min(tx_start) AS extent FROM transcripts GROUP BY 1 ORDER BY extent DESC, gene_key""",
)
def longest_genes(t: Tables) -> DataFrame:
    return stats.longest_genes(t.transcripts)


@query("duplicate_symbols", "SELECT upper(gene_symbol) AS symbol, count(*) AS n FROM genes GROUP BY 1 HAVING count(*) > 1")
def duplicate_symbols(t: Tables) -> DataFrame:
    return stats.duplicate_symbols(t.genes)
