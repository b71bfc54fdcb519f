"""Queries on exons, transcripts and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.functions import coords, ids, text
from splicelake.operators import domains as dom
from splicelake.operators import exons as ex
from splicelake.operators import search
from splicelake.operators.crosswalk import clean_crosswalk
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query
from splicelake.schemas import SPECIES, species_attribute


@query("exons_to_cds", "SELECT * FROM cds")
def exons_to_cds(t: Tables) -> DataFrame:
    return ex.exons_to_cds(t.exons, t.transcripts).drop("coding_rank")


@query(
    "exon_order",
    """SELECT tx_key, genomic_start_tx, genomic_end_tx,
       row_number() OVER (PARTITION BY tx_key ORDER BY sort_key) AS order_in_transcript,
       count(*) OVER (PARTITION BY tx_key) AS exon_count
       FROM (SELECT *, CASE WHEN gene_key % 2 = 0 THEN genomic_start_tx ELSE -genomic_start_tx END AS sort_key FROM exons)""",
)
def exon_order(t: Tables) -> DataFrame:
    """Rank exons along the transcript: up the genome on the plus strand, down on the minus strand."""
    stranded = t.exons.join(t.genes.select("gene_key", "strand"), "gene_key")
    keyed = stranded.select(
        "tx_key",
        "genomic_start_tx",
        "genomic_end_tx",
        F.when(F.col("strand") == "-", -F.col("genomic_start_tx")).otherwise(F.col("genomic_start_tx")).alias("sort_key"),
    )
    return ex.order_exons(keyed, "tx_key", ["sort_key"]).drop("sort_key")


@query("unique_exons", "SELECT DISTINCT gene_key, genomic_start_tx, genomic_end_tx FROM exons")
def unique_exons(t: Tables) -> DataFrame:
    return ex.unique_exons(t.exons, ["gene_key", "genomic_start_tx", "genomic_end_tx"])


@query(
    "utr_flags",
    """SELECT c.tx_key, c.order_in_transcript, abs_start_cds = 0 AS is_utr_all,
       CASE WHEN abs_start_cds <> 0 AND cds_start BETWEEN genomic_start_tx AND genomic_end_tx THEN cds_start - genomic_start_tx END AS utr_start_offset,
       CASE WHEN abs_start_cds <> 0 AND cds_end BETWEEN genomic_start_tx AND genomic_end_tx THEN genomic_end_tx - cds_end END AS utr_end_offset
       FROM cds c JOIN transcripts t ON c.tx_key = t.tx_key""",
)
def utr_flags(t: Tables) -> DataFrame:
    x = t.cds.join(t.transcripts.select("tx_key", "cds_start", "cds_end"), "tx_key")
    flags = coords.utr_flags(
        F.col("genomic_start_tx"), F.col("genomic_end_tx"), F.col("abs_start_cds"), F.col("cds_start"), F.col("cds_end")
    )
    return x.select("tx_key", "order_in_transcript", *[c.alias(n) for n, c in flags.items()])


@query(
    "coding_limits",
    """SELECT c.tx_key, c.order_in_transcript,
       CASE WHEN abs_start_cds <> 0 AND cds_start BETWEEN genomic_start_tx AND genomic_end_tx THEN cds_start ELSE genomic_start_tx END AS lim_start,
       CASE WHEN abs_start_cds <> 0 AND cds_end BETWEEN genomic_start_tx AND genomic_end_tx THEN cds_end ELSE genomic_end_tx END AS lim_end
       FROM cds c JOIN transcripts t ON c.tx_key = t.tx_key""",
)
def coding_limits(t: Tables) -> DataFrame:
    x = t.cds.join(t.transcripts.select("tx_key", "cds_start", "cds_end"), "tx_key")
    limits = coords.coding_limits(
        F.col("genomic_start_tx"), F.col("genomic_end_tx"), F.col("abs_start_cds"), F.col("cds_start"), F.col("cds_end")
    )
    return x.select("tx_key", "order_in_transcript", *[c.alias(n) for n, c in limits.items()])


@query(
    "exon_usage",
    """SELECT gene_key, lim_start, lim_end, string_agg(tid, ', ' ORDER BY tid) AS transcripts, count(*) AS n_transcripts,
       dense_rank() OVER (PARTITION BY gene_key ORDER BY lim_start, lim_end) AS group_no
       FROM (SELECT c.gene_key, coalesce(transcript_refseq_id, transcript_ensembl_id) AS tid,
         CASE WHEN abs_start_cds <> 0 AND cds_start BETWEEN genomic_start_tx AND genomic_end_tx THEN cds_start ELSE genomic_start_tx END AS lim_start,
         CASE WHEN abs_start_cds <> 0 AND cds_end BETWEEN genomic_start_tx AND genomic_end_tx THEN cds_end ELSE genomic_end_tx END AS lim_end
         FROM cds c JOIN transcripts t ON c.tx_key = t.tx_key
         WHERE protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL)
       GROUP BY gene_key, lim_start, lim_end""",
)
def exon_usage(t: Tables) -> DataFrame:
    return ex.exon_usage(t.cds, t.transcripts)


@query(
    "region_filter",
    """SELECT e.tx_key, e.order_in_transcript, e.genomic_start_tx, e.genomic_end_tx FROM exons e
       JOIN (SELECT gene_key, min(tx_start) AS a, max(tx_end) AS b FROM transcripts GROUP BY 1) g ON e.gene_key = g.gene_key
       WHERE e.genomic_start_tx <= b - floor((b - a) / 4.0) AND e.genomic_end_tx >= a + floor((b - a) / 4.0)""",
)
def region_filter(t: Tables) -> DataFrame:
    """Exons that touch the middle half of their gene."""
    quarter = F.floor((F.col("gene_end") - F.col("gene_start")) / F.lit(4.0))
    seen = ex.region_view(t.exons, t.transcripts, F.col("gene_start") + quarter, F.col("gene_end") - quarter)
    return seen.select("tx_key", "order_in_transcript", "genomic_start_tx", "genomic_end_tx")


@query(
    "coding_reviewed_filter",
    """SELECT tx_key, transcript_refseq_id, transcript_ensembl_id FROM transcripts
       WHERE (protein_refseq_id IS NOT NULL OR protein_ensembl_id IS NOT NULL)
       AND (transcript_refseq_id IS NULL OR substr(transcript_refseq_id, 1, 2) = 'NM')""",
)
def coding_reviewed_filter(t: Tables) -> DataFrame:
    return ex.coding_transcripts(t.transcripts, reviewed_only=True).select(
        "tx_key", "transcript_refseq_id", "transcript_ensembl_id"
    )


@query(
    "strand_mirror",
    """SELECT t.tx_key, CASE WHEN strand = '-' THEN b - tx_end ELSE tx_start END AS view_start,
       CASE WHEN strand = '-' THEN b - tx_start ELSE tx_end END AS view_end,
       CASE WHEN strand = '-' THEN b - tx_start ELSE tx_start - a END AS start_from_five_prime
       FROM transcripts t JOIN genes g ON t.gene_key = g.gene_key
       JOIN (SELECT gene_key, min(tx_start) AS a, max(tx_end) AS b FROM transcripts GROUP BY 1) x ON t.gene_key = x.gene_key""",
)
def strand_mirror(t: Tables) -> DataFrame:
    extent = t.transcripts.groupBy("gene_key").agg(F.min("tx_start").alias("a"), F.max("tx_end").alias("b"))
    x = t.transcripts.select("tx_key", "gene_key", "tx_start", "tx_end").join(extent, "gene_key")
    x = x.join(t.genes.select("gene_key", "strand"), "gene_key")
    view = coords.mirror_interval(F.col("strand"), F.col("b"), F.col("tx_start"), F.col("tx_end"))
    return x.select(
        "tx_key",
        *[c.alias(n) for n, c in view.items()],
        coords.strand_position(F.col("strand"), F.col("a"), F.col("b"), F.col("tx_start")).alias("start_from_five_prime"),
    )


@query(
    "first_long_gap",
    """WITH u AS (SELECT DISTINCT gene_key, genomic_start_tx AS s, genomic_end_tx AS e FROM exons),
       w AS (SELECT *, max(e) OVER (PARTITION BY gene_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM u)
       SELECT gene_key, min(p) AS gap_start, arg_min(s - p, p) AS gap_length FROM w WHERE s > p + 100 GROUP BY gene_key""",
)
def first_long_gap(t: Tables) -> DataFrame:
    """Genes here are compact, so the gap threshold is 100 bases."""
    return ex.first_long_gap(t.exons, threshold=100)


@query(
    "rank_transcripts",
    """SELECT t.gene_key, t.tx_key, row_number() OVER (PARTITION BY t.gene_key ORDER BY CASE WHEN canonical <> 0 THEN 0 ELSE 1 END,
       -coalesce(length, 0), t.tx_key) AS display_rank FROM transcripts t LEFT JOIN proteins p ON t.tx_key = p.tx_key""",
)
def rank_transcripts(t: Tables) -> DataFrame:
    rows = t.transcripts.select("gene_key", "tx_key", "canonical").join(
        t.proteins.select("tx_key", F.col("length").alias("protein_nt")), "tx_key", "left"
    )
    return search.rank_transcripts(rows).select("gene_key", "tx_key", "display_rank")


@query(
    "transcript_view",
    """SELECT t.gene_key, t.tx_key, concat_ws(' / ', t.transcript_refseq_id, t.transcript_ensembl_id) AS transcript_name,
       concat_ws(' / ', t.protein_refseq_id, t.protein_ensembl_id) AS protein_name, length * 3 AS protein_nt, canonical,
       row_number() OVER (PARTITION BY t.gene_key ORDER BY CASE WHEN canonical <> 0 THEN 0 ELSE 1 END, -length, t.tx_key) AS display_rank
       FROM transcripts t JOIN proteins p ON t.tx_key = p.tx_key
       WHERE t.transcript_refseq_id IS NULL OR substr(t.transcript_refseq_id, 1, 2) = 'NM'""",
)
def transcript_view(t: Tables) -> DataFrame:
    return search.transcript_view(t.transcripts, t.proteins, reviewed_only=True)


# --- scalars ------------------------------------------------------------------


@query(
    "aa_to_nuc",
    """SELECT tx_key, type_id, aa_start, aa_end_in, ext_id, CASE WHEN aa_end_in IS NULL THEN 0 ELSE aa_start * 3 - 2 END AS nuc_start,
       CASE WHEN aa_end_in IS NULL THEN 0 ELSE aa_end_in * 3 END AS nuc_end,
       CASE WHEN aa_end_in IS NULL THEN concat('Error_', coalesce(name, 'None')) ELSE name END AS name
       FROM (SELECT *, CASE WHEN type_id % 10 = 9 THEN NULL ELSE aa_end END AS aa_end_in FROM domains)""",
)
def aa_to_nuc(t: Tables) -> DataFrame:
    x = t.domains.withColumn("aa_end_in", F.when(F.col("type_id") % 10 != 9, F.col("aa_end")))
    span = coords.aa_to_nuc(F.col("aa_start"), F.col("aa_end_in"), F.col("name"))
    return x.select("tx_key", "type_id", "aa_start", "aa_end_in", "ext_id", *[c.alias(n) for n, c in span.items()])


RAW_EXT = (
    "concat(CASE type_id % 7 WHEN 0 THEN 'PF' WHEN 1 THEN 'SM' WHEN 2 THEN 'cd' WHEN 3 THEN 'TIGRFAMS' WHEN 4 THEN 'ipr' "
    "WHEN 5 THEN 'PRK' ELSE 'Interpro' END, CAST(type_id AS STRING))"
)


@query(
    "normalize_ext_id",
    f"""SELECT DISTINCT ext_raw, concat(CASE type_id % 7 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cd' WHEN 3 THEN 'tigr' ELSE 'IPR' END,
       CAST(type_id AS STRING)) AS ext_norm,
       CASE type_id % 7 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cdd' WHEN 3 THEN 'tigrfams' ELSE 'interpro' END AS ext_source,
       'accepted' AS verdict FROM (SELECT type_id, {RAW_EXT} AS ext_raw FROM domains) WHERE type_id % 7 <> 5
       UNION ALL SELECT DISTINCT ext_raw, NULL, NULL, 'rejected' FROM (SELECT type_id, {RAW_EXT} AS ext_raw FROM domains) WHERE type_id % 7 = 5""",
)
def normalize_ext_id(t: Tables) -> DataFrame:
    raw = t.domains.selectExpr(f"{RAW_EXT} AS ext_raw").distinct()
    good, bad = ids.normalize_ext_id(raw, "ext_raw")
    return good.withColumn("verdict", F.lit("accepted")).unionByName(
        bad.withColumn("verdict", F.lit("rejected")), allowMissingColumns=True
    )


@query(
    "strip_version",
    """SELECT tx_key, CASE WHEN strpos(refseq_tx, '.') > 0 THEN substr(refseq_tx, 1, strpos(refseq_tx, '.') - 1) ELSE refseq_tx END AS bare,
       CASE WHEN refseq_tx LIKE 'mito%' THEN 'mito' WHEN strpos(refseq_tx, '.') > 0 THEN substr(refseq_tx, strpos(refseq_tx, '.') + 1) END AS version
       FROM (SELECT ord AS tx_key, refseq_tx FROM crosswalk)""",
)
def strip_version(t: Tables) -> DataFrame:
    x = clean_crosswalk(t.crosswalk_raw)
    return x.select(
        F.col("ord").alias("tx_key"),
        ids.strip_version(F.col("refseq_tx")).alias("bare"),
        ids.version_of(F.col("refseq_tx")).alias("version"),
    )


@query(
    "display_name",
    """SELECT tx_key, CASE WHEN transcript_refseq_id IS NULL THEN transcript_ensembl_id WHEN transcript_ensembl_id IS NULL THEN transcript_refseq_id
       ELSE concat(transcript_refseq_id, ' / ', transcript_ensembl_id) END AS transcript_name,
       CASE WHEN protein_refseq_id IS NULL THEN protein_ensembl_id WHEN protein_ensembl_id IS NULL THEN protein_refseq_id
       ELSE concat(protein_refseq_id, ' / ', protein_ensembl_id) END AS protein_name,
       coalesce(transcript_refseq_id, transcript_ensembl_id) AS transcript_id, coalesce(protein_refseq_id, protein_ensembl_id) AS protein_id
       FROM transcripts""",
)
def display_name(t: Tables) -> DataFrame:
    tr, te = F.col("transcript_refseq_id"), F.col("transcript_ensembl_id")
    pr, pe = F.col("protein_refseq_id"), F.col("protein_ensembl_id")
    return t.transcripts.select(
        "tx_key",
        ids.display_name(tr, te).alias("transcript_name"),
        ids.display_name(pr, pe).alias("protein_name"),
        ids.preferred_id(tr, te).alias("transcript_id"),
        ids.preferred_id(pr, pe).alias("protein_id"),
    )


@query(
    "domain_label",
    """SELECT tx_key, type_id, aa_start, aa_end, ext_id, coalesce(CASE WHEN trim(domain_name) <> '' THEN domain_name END,
       CASE WHEN type_id % 2 = 0 THEN concat('other_', CAST(type_id AS STRING)) END, ext_id) AS label,
       regexp_matches(ext_id, '^(?i:smart|pfam|tigr|ipr)[0-9]+$|^cd[0-9]+$') AS is_id
       FROM (SELECT *, CASE WHEN type_id % 11 = 0 THEN ' ' ELSE name END AS domain_name FROM domains)""",
)
def domain_label(t: Tables) -> DataFrame:
    x = t.domains.withColumn("domain_name", F.when(F.col("type_id") % 11 == 0, " ").otherwise(F.col("name")))
    other = F.when(F.col("type_id") % 2 == 0, F.concat(F.lit("other_"), F.col("type_id").cast("string")))
    return x.select(
        "tx_key", "type_id", "aa_start", "aa_end", "ext_id",
        text.domain_label(F.col("domain_name"), other, F.col("ext_id")).alias("label"),
        ids.looks_like_id(F.col("ext_id")).alias("is_id"),
    )


@query(
    "source_label",
    """SELECT DISTINCT ext_id AS source, CASE type_id % 5 WHEN 0 THEN 'Pfam' WHEN 1 THEN 'Smart' WHEN 2 THEN 'CDD' WHEN 3 THEN 'Tigr' ELSE 'InterPro' END AS label,
       CASE type_id % 5 WHEN 0 THEN concat('https://pfam.xfam.org/family/PF', substr(ext_id, 5))
       WHEN 1 THEN concat('http://smart.embl-heidelberg.de/smart/do_annotation.pl?DOMAIN=', substr(ext_id, 6))
       WHEN 2 THEN concat('https://www.ncbi.nlm.nih.gov/Structure/cdd/cddsrv.cgi?uid=', ext_id)
       WHEN 3 THEN concat('http://tigrfams.jcvi.org/cgi-bin/HmmReportPage.cgi?acc=', upper(ext_id))
       ELSE concat('https://www.ebi.ac.uk/interpro/entry/InterPro/', ext_id, '/') END AS url FROM domains""",
)
def source_label(t: Tables) -> DataFrame:
    """Sources of every collapsed event, from its joined accession list."""
    events = dom.collapse_events(t.domains)
    one = events.select(F.explode(F.split("ext_id", "; ")).alias("source")).distinct()
    return one.select("source", ids.source_of(F.col("source")).alias("label"), ids.url_for(F.col("source")).alias("url"))


@query(
    "title_symbol",
    """SELECT gene_key, concat(upper(substr(gene_symbol, 1, 1)), lower(substr(gene_symbol, 2))) AS title FROM genes""",
)
def title_symbol(t: Tables) -> DataFrame:
    return t.genes.select("gene_key", text.title_symbol(F.col("gene_symbol")).alias("title"))


@query(
    "locus_text",
    """SELECT t.gene_key, concat('chr', chromosome, ':', format('{:,}', min(tx_start)), '-', format('{:,}', max(tx_end))) AS locus
       FROM transcripts t JOIN genes g ON t.gene_key = g.gene_key GROUP BY t.gene_key, chromosome""",
)
def locus_text(t: Tables) -> DataFrame:
    extent = t.transcripts.groupBy("gene_key").agg(F.min("tx_start").alias("a"), F.max("tx_end").alias("b"))
    return extent.join(t.genes.select("gene_key", "chromosome"), "gene_key").select(
        "gene_key", text.locus_text(F.col("chromosome"), F.col("a"), F.col("b")).alias("locus")
    )


def _species_case(position: int) -> str:
    branches = " ".join(f"WHEN '{k}' THEN '{v[position]}'" for k, v in SPECIES.items())
    return f"CASE specie {branches} END"


@query(
    "entity_links",
    f"""SELECT tx_key, {_species_case(1)} AS display_build, {_species_case(2)} AS short_code,
       CASE specie WHEN 'H_sapiens' THEN 9606 WHEN 'M_musculus' THEN 10090 WHEN 'R_norvegicus' THEN 10116 WHEN 'D_rerio' THEN 7955 ELSE 8364 END AS tax_id,
       'https://www.ensembl.org/' || {_species_case(0)} || '/Gene/Summary?db=core;g=' || g.gene_ensembl_id AS gene_link,
       'https://www.ensembl.org/' || {_species_case(0)} || '/Transcript/Summary?db=core;t=' || transcript_ensembl_id AS transcript_link,
       'https://www.ensembl.org/' || {_species_case(0)} || '/Transcript/ProteinSummary?db=core;p=' || protein_ensembl_id AS protein_link
       FROM transcripts t JOIN genes g ON t.gene_key = g.gene_key""",
)
def entity_links(t: Tables) -> DataFrame:
    x = t.transcripts.drop("gene_ensembl_id").join(t.genes.select("gene_key", "gene_ensembl_id", "specie"), "gene_key")
    name = species_attribute(F.col("specie"), "ensembl_name")
    return x.select(
        "tx_key",
        species_attribute(F.col("specie"), "display_build").alias("display_build"),
        species_attribute(F.col("specie"), "short_code").alias("short_code"),
        species_attribute(F.col("specie"), "tax_id").alias("tax_id"),
        ids.ensembl_gene_link(name, F.col("gene_ensembl_id")).alias("gene_link"),
        ids.ensembl_transcript_link(name, F.col("transcript_ensembl_id")).alias("transcript_link"),
        ids.ensembl_protein_link(name, F.col("protein_ensembl_id")).alias("protein_link"),
    )


@query(
    "merge_text",
    """SELECT tx_key, CASE WHEN description IS NULL THEN synonyms WHEN synonyms IS NULL OR contains(lower(description), lower(synonyms)) THEN description
       WHEN contains(lower(synonyms), lower(description)) THEN synonyms ELSE concat(description, '; ', synonyms) END AS note,
       CASE WHEN description IS NULL AND synonyms IS NULL THEN NULL ELSE concat_ws('; ', description, synonyms) END AS descr,
       CASE WHEN description IS NULL THEN g_syn WHEN g_syn IS NULL THEN description
       ELSE array_to_string(list_sort(list_distinct(list_concat(string_split(description, '; '), string_split(g_syn, '; ')))), '; ') END AS names
       FROM (SELECT p.*, g.synonyms AS g_syn FROM proteins p JOIN genes g ON p.gene_key = g.gene_key)""",
)
def merge_text(t: Tables) -> DataFrame:
    x = t.proteins.join(t.genes.select("gene_key", F.col("synonyms").alias("g_syn")), "gene_key")
    d, s = F.col("description"), F.col("synonyms")
    return x.select(
        "tx_key",
        text.merge_note(d, s).alias("note"),
        text.merge_description(d, s).alias("descr"),
        text.merge_string_set(d, F.col("g_syn")).alias("names"),
    )
