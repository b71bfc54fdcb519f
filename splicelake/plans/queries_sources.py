"""The readers, run over files written from the whole derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators.crosswalk import ID_COLUMNS, clean_crosswalk
from splicelake.plans import text_inputs as files
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query
from splicelake.sources import checks, ensembl, flatfile, interpro, refseq, tables
from splicelake.sources.gff3 import read_gff3
from splicelake.streaming import idmap

SEGMENTS = """seg AS (SELECT c.tx_key, min(greatest(genomic_start_tx, coalesce(cds_start, tx_start))) AS cs, max(least(genomic_end_tx, coalesce(cds_end, tx_end))) AS ce
         FROM cds c JOIN transcripts t ON c.tx_key = t.tx_key WHERE abs_start_cds > 0 GROUP BY 1)"""


@query(
    "read_gff3",
    """SELECT 'gene' AS type, count(DISTINCT gene_key) AS n FROM transcripts WHERE transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL
       UNION ALL SELECT 'mRNA', count(*) FROM transcripts WHERE transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL
       UNION ALL SELECT 'exon', count(*) FROM exons e JOIN transcripts t ON e.tx_key = t.tx_key WHERE transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL
       UNION ALL SELECT 'CDS', count(*) FROM cds e JOIN transcripts t ON e.tx_key = t.tx_key WHERE transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL
         AND protein_ensembl_id IS NOT NULL AND abs_start_cds > 0""",
)
def gff_features(t: Tables) -> DataFrame:
    return read_gff3(t.spark, files.ensembl_gff(t)).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "ensembl_annotation",
    f"""WITH {SEGMENTS} SELECT t.transcript_ensembl_id, t.gene_ensembl_id, concat(gene_symbol, ' x') AS gene_symbol, chromosome, strand, tx_start, tx_end,
         CASE WHEN protein_ensembl_id IS NOT NULL THEN cs END AS cds_start, CASE WHEN protein_ensembl_id IS NOT NULL THEN ce END AS cds_end,
         CASE WHEN cs IS NOT NULL THEN protein_ensembl_id END AS protein_ensembl_id, t.tx_key % 12 = 0 AS nmd,
         CAST(CASE WHEN canonical >= 2 THEN 2 ELSE 0 END AS INTEGER) AS canonical, order_in_transcript, genomic_start_tx, genomic_end_tx
       FROM transcripts t JOIN genes g ON g.gene_key = t.gene_key JOIN exons e ON e.tx_key = t.tx_key LEFT JOIN seg ON seg.tx_key = t.tx_key
       WHERE t.transcript_ensembl_id IS NOT NULL AND t.gene_ensembl_id IS NOT NULL""",
)
def ensembl_annotation(t: Tables) -> DataFrame:
    f = read_gff3(t.spark, files.ensembl_gff(t))
    genes = ensembl.ensembl_genes(f)
    tx = ensembl.ensembl_transcripts(f, genes)
    kept = ensembl.genes_with_transcripts(genes, tx)
    spans = ensembl.ensembl_cds(f, tx)
    return (
        ensembl.ensembl_exons(f, tx)
        .join(tx.drop("bare_id", "ord"), "transcript_ensembl_id")
        .join(kept.select("gene_ensembl_id", "gene_symbol"), "gene_ensembl_id")
        .join(spans, "transcript_ensembl_id", "left")
    )


@query(
    "refseq_annotation",
    f"""WITH {SEGMENTS} SELECT t.transcript_refseq_id, t.transcript_ensembl_id AS own_ensembl_id, t.gene_geneid_id, gene_symbol, coalesce(synonyms, ' ') AS synonyms, chromosome, strand,
         tx_start, tx_end, CASE WHEN protein_refseq_id IS NOT NULL THEN cs END AS cds_start, CASE WHEN protein_refseq_id IS NOT NULL THEN ce END AS cds_end,
         CASE WHEN cs IS NOT NULL THEN protein_refseq_id END AS protein_refseq_id, CAST(canonical % 2 AS INTEGER) AS canonical, order_in_transcript, genomic_start_tx, genomic_end_tx
       FROM transcripts t JOIN genes g ON g.gene_key = t.gene_key JOIN exons e ON e.tx_key = t.tx_key LEFT JOIN seg ON seg.tx_key = t.tx_key
       WHERE t.transcript_refseq_id IS NOT NULL AND t.gene_geneid_id IS NOT NULL""",
)
def refseq_annotation(t: Tables) -> DataFrame:
    f = read_gff3(t.spark, files.refseq_gff(t))
    chromosomes = refseq.seqid_to_chromosome(f)
    genes = refseq.refseq_genes(f, chromosomes)
    tx = refseq.refseq_transcripts(f, chromosomes, genes)
    kept = refseq.genes_with_transcripts(genes, tx)
    spans = refseq.refseq_cds(f, chromosomes, tx)
    return (
        refseq.refseq_exons(f, chromosomes, tx)
        .join(tx.drop("seqid", "ord"), "transcript_refseq_id")
        .join(kept.select("gene_geneid_id", "gene_symbol", "synonyms"), "gene_geneid_id")
        .join(spans, "transcript_refseq_id", "left")
    )


@query(
    "flatfile_proteins",
    """SELECT protein_refseq_id, coalesce(description, 'none') AS description, length, synonyms, transcript_refseq_id FROM proteins
       WHERE protein_refseq_id IS NOT NULL AND transcript_refseq_id IS NOT NULL""",
)
def flatfile_proteins(t: Tables) -> DataFrame:
    return flatfile.proteins(flatfile.read_protein_flatfile(t.spark, files.protein_flatfile(t)))


@query(
    "flatfile_regions",
    """SELECT protein_refseq_id, aa_start, aa_end, coalesce(name, 'unnamed') AS name, ext_id, cdd, 'text of the domain' AS note FROM domains d
       JOIN proteins p ON d.tx_key = p.tx_key WHERE protein_refseq_id IS NOT NULL AND transcript_refseq_id IS NOT NULL""",
)
def flatfile_regions(t: Tables) -> DataFrame:
    return flatfile.regions(flatfile.read_protein_flatfile(t.spark, files.protein_flatfile(t)))


@query(
    "require_protein",
    """SELECT CASE WHEN protein_refseq_id IS NOT NULL THEN 'kept' ELSE 'dropped' END AS outcome, count(*) AS n FROM transcripts
       WHERE transcript_refseq_id IS NOT NULL GROUP BY 1""",
)
def require_protein(t: Tables) -> DataFrame:
    p = flatfile.proteins(flatfile.read_protein_flatfile(t.spark, files.protein_flatfile(t)))
    kept, dropped = refseq.require_protein(
        t.transcripts.filter("transcript_refseq_id IS NOT NULL"), flatfile.trans2pro(p)
    )
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(o).alias("outcome"), "n") for o, d in (("kept", kept), ("dropped", dropped))]
    return parts[0].unionByName(parts[1])


@query(
    "domain_tables",
    """SELECT transcript_ensembl_id, protein_ensembl_id, concat(CASE type_id % 5 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cd' WHEN 3 THEN 'tigr' ELSE 'ipr' END,
         regexp_replace(ext_id, '^[A-Za-z]+', '')) AS ext_id, aa_start, aa_end, CASE WHEN type_id % 5 = 4 THEN coalesce(name, 'short') END AS name,
         CASE WHEN type_id % 5 = 4 THEN 'long text' END AS note, CASE type_id % 5 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cdd' WHEN 3 THEN 'tigrfams' ELSE 'interpro' END AS source
       FROM domains d JOIN proteins p ON d.tx_key = p.tx_key WHERE protein_ensembl_id IS NOT NULL AND transcript_ensembl_id IS NOT NULL""",
)
def domain_tables(t: Tables) -> DataFrame:
    domains, _ = tables.read_domain_tables(t.spark, files.domain_tables(t), "H_sapiens")
    return domains


@query(
    "ensembl_proteins",
    """WITH ip AS (SELECT DISTINCT d.tx_key FROM domains d JOIN proteins p ON d.tx_key = p.tx_key WHERE type_id % 5 = 4 AND protein_ensembl_id IS NOT NULL AND transcript_ensembl_id IS NOT NULL)
       SELECT p.protein_ensembl_id, p.transcript_ensembl_id, CASE WHEN p.tx_key % 12 = 0 THEN 'Nonsense Mediated Decay (NMD)' END AS description,
         CAST(greatest(0, floor((SELECT max(abs_end_cds) FROM cds c WHERE c.tx_key = p.tx_key) / 3.0 - 1)) AS BIGINT) AS length
       FROM proteins p JOIN ip ON ip.tx_key = p.tx_key JOIN transcripts t ON t.tx_key = p.tx_key WHERE gene_ensembl_id IS NOT NULL""",
)
def ensembl_proteins(t: Tables) -> DataFrame:
    f = read_gff3(t.spark, files.ensembl_gff(t))
    tx = ensembl.ensembl_transcripts(f, ensembl.ensembl_genes(f))
    domains, pairs = tables.read_domain_tables(t.spark, files.domain_tables(t), "H_sapiens")
    ends = t.cds.groupBy("tx_key").agg(F.max("abs_end_cds").alias("abs_end_cds"))
    coding = ends.join(t.transcripts.select("tx_key", "transcript_ensembl_id"), "tx_key")
    proteins, _, _ = ensembl.ensembl_proteins(pairs, tx, coding, domains)
    return proteins


@query("crosswalk_file", "SELECT gene_id, ens_gene, refseq_tx, ens_tx, refseq_prot, ens_prot FROM crosswalk JOIN transcripts t ON t.tx_key = ord JOIN genes g ON g.gene_key = t.gene_key WHERE specie = 'M_musculus'")
def crosswalk_file(t: Tables) -> DataFrame:
    """The rows of one species."""
    return clean_crosswalk(tables.read_id_crosswalk(t.spark, files.crosswalk_file(t)), 10090).select(*ID_COLUMNS)


@query(
    "orthology_files",
    """SELECT a_id, upper(a.gene_symbol) AS a_name, a_species, b_id, upper(b.gene_symbol) AS b_name, b_species FROM ortholog_rows
       JOIN genes a ON a.gene_ensembl_id = a_id JOIN genes b ON b.gene_ensembl_id = b_id""",
)
def orthology_files(t: Tables) -> DataFrame:
    return tables.read_orthology_pairs(t.spark, files.orthology_files(t))


@query(
    "interpro_matches",
    """SELECT concat('P', CAST(tx_key AS VARCHAR)) AS protein_interpro_id, CASE WHEN type_id % 2 = 0 THEN ext_id ELSE concat('M', ext_id) END AS domain_id,
         CASE WHEN type_id % 2 = 0 THEN 'entry' ELSE 'member' END AS domain_name, aa_start AS "start", aa_end AS "end",
         CASE WHEN type_id % 4 <> 0 THEN aa_end - aa_start + 0.5e0 END AS score, i.entry_type AS type, CASE WHEN i.accession IS NOT NULL THEN concat('about ', i.accession) END AS description
       FROM domains d LEFT JOIN (SELECT DISTINCT accession, entry_type FROM entry_index) i ON i.accession = CASE WHEN type_id % 2 = 0 THEN ext_id ELSE concat('M', ext_id) END
       WHERE type_id % 3 = 0 AND tx_key % 5 <> 3""",
)
def interpro_matches(t: Tables) -> DataFrame:
    """Proteins with key % 5 = 3 are not stored, so their matches are dropped."""
    matches = interpro.read_interpro_matches(t.spark, files.match_xml(t))
    stored = t.proteins.filter("tx_key % 5 <> 3").select(F.concat(F.lit("P"), F.col("tx_key").cast("string")).alias("protein_interpro_id"))
    entries = t.entries.select(
        "accession", F.col("entry_type").alias("type"), F.concat(F.lit("about "), "accession").alias("description")
    )
    return interpro.representative_domains(matches, stored, entries)


@query(
    "genepred_explode",
    """SELECT concat('uc', CAST(e.tx_key AS VARCHAR)) AS name, chromosome, strand, order_in_transcript, genomic_start_tx, genomic_end_tx FROM exons e JOIN genes g ON g.gene_key = e.gene_key""",
)
def genepred_explode(t: Tables) -> DataFrame:
    return tables.genepred_exons(tables.read_genepred(t.spark, files.genepred_file(t)))


SUMMARY = {
    "species": "CAST(c_nationkey AS STRING)",
    "accession": "concat('GCF_', lpad(CAST(c_custkey AS STRING), 9, '0'), '.', CAST(c_custkey % 3 AS STRING))",
    "refseq_category": "CASE WHEN c_custkey % 50 = 0 THEN 'reference genome' ELSE 'representative genome' END",
    "version_status": "CASE WHEN c_custkey % 3 = 0 THEN 'latest' ELSE 'replaced' END",
    "ftp_path": "CASE WHEN c_nationkey % 5 = 0 OR c_custkey % 4 = 0 THEN 'na' ELSE concat('https://host/', lpad(CAST(c_custkey AS STRING), 9, '0')) END",
    "ord": "c_custkey",
}
STAGED_NAME = "concat('GCF_', lpad(CAST(c_custkey AS STRING), 9, '0'), '.', CAST(c_custkey % 7 AS STRING), '_asm')"


def _summary_sql() -> str:
    return ", ".join(f"{e} AS {n}" for n, e in SUMMARY.items())


@query(
    "latest_version_pick",
    f"""WITH s AS (SELECT {_summary_sql()} FROM customer), l AS (SELECT * FROM s WHERE version_status = 'latest'),
       flag AS (SELECT species, coalesce(arg_max(accession, ord) FILTER (refseq_category = 'reference genome'), arg_min(accession, ord)) AS accession,
         arg_min(ftp_path, (CASE WHEN refseq_category = 'reference genome' THEN 0 ELSE 1 END, ftp_path)) FILTER (ftp_path <> 'na') AS published FROM l GROUP BY 1),
       st AS (SELECT CAST(c_nationkey AS VARCHAR) AS species, {STAGED_NAME} AS name FROM customer)
       SELECT f.species, f.accession, coalesce(published, (SELECT max(name) FROM st WHERE st.species = f.species AND starts_with(name, split_part(f.accession, '.', 1))),
         (SELECT max(name) FROM st WHERE st.species = f.species)) AS path FROM flag f""",
)
def latest_version_pick(t: Tables) -> DataFrame:
    """customer read as an assembly summary: one species per nation."""
    c = t.source("customer")
    summary = c.selectExpr(*[f"{e} AS {n}" for n, e in SUMMARY.items()])
    staged = c.selectExpr("CAST(c_nationkey AS STRING) AS species", f"{STAGED_NAME} AS name")
    return tables.latest_assembly(summary, staged)


@query(
    "cluster_count_preview",
    """SELECT count(*) AS n_rows, count(DISTINCT concat_ws('/', lang, source)) AS n_clusters, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents""",
)
def cluster_count_preview(t: Tables) -> DataFrame:
    results = checks.read_result_csv(t.spark, files.result_csv(t), "doc_id BIGINT, cluster STRING, text STRING")
    chars = results.agg(F.sum(F.length("text")).alias("n_chars"))
    return checks.cluster_counts(results).withColumn("n_chars", chars.scalar())


@query(
    "json_flatten",
    """SELECT event_id, concat('ev', CAST(event_id AS VARCHAR)) AS accession, event_type AS name, 'log' AS source_database, 'domain' AS entry_type,
       concat('k:', json_extract_string(props, '$.k'), ';type:', event_type) AS members, concat('GO:', CAST(user_id AS VARCHAR), ',GO:', json_extract_string(props, '$.k')) AS go_terms FROM events""",
)
def json_flatten(t: Tables) -> DataFrame:
    """Every event wrapped as an entry document, its JSON props among the members."""
    k = F.get_json_object("props", "$.k")
    doc = F.concat(
        F.lit('{"metadata":{"accession":"ev'), F.col("event_id").cast("string"), F.lit('","name":"'), "event_type",
        F.lit('","source_database":"log","type":"domain","member_databases":{"k":{"'), k, F.lit('":"x"},"type":{"'), "event_type",
        F.lit('":"y"}},"go_terms":[{"identifier":"GO:'), F.col("user_id").cast("string"), F.lit('"},{"identifier":"GO:'), k, F.lit('"}]}}'),
    )
    flat = interpro.flatten_entry_json(t.source("events").select("event_id", doc.alias("value")))
    return flat.select(F.substr("accession", F.lit(3)).cast("bigint").alias("event_id"), "*")


HEADER_SQL = """SELECT page_id, starts_with(ltrim(html), '<') AS is_error_page,
       starts_with(ltrim(html), 'Gene stable ID') AND NOT starts_with(ltrim(html), '<') AS is_valid FROM pages"""


@query("page_headers", HEADER_SQL)
def page_headers(t: Tables) -> DataFrame:
    """First-line test of every page as if it were a saved table."""
    lines = t.source("pages").select("page_id", F.ltrim(F.split_part("html", F.lit("\n"), F.lit(1))).alias("first_line"))
    return checks.with_validity(lines, "first_line", ["Gene stable ID"]).drop("first_line")


@query("sniff_headers", HEADER_SQL)
def sniff_headers(t: Tables) -> DataFrame:
    """The same test on every page saved as a file."""
    found = checks.sniff_headers(t.spark, files.header_files(t), ["Gene stable ID"])
    page = F.regexp_extract("file", "/page_id=([0-9]+)/", 1).cast("bigint")
    return found.select(page.alias("page_id"), "is_error_page", "is_valid")


@query("uniprot_idmap", "SELECT accession, coalesce(refseq_id, '') AS refseq_id, coalesce(enst_id, '') AS enst_id FROM mapping")
def uniprot_idmap(t: Tables) -> DataFrame:
    """The mapping file read back, empty cells as empty strings."""
    return interpro.read_uniprot_idmap(t.spark, files.uniprot_idmap_file(t)).drop("ord")


@query(
    "interpro_descriptions",
    """SELECT DISTINCT accession, entry_type AS type, concat('about ', accession, ' & its kin') AS description FROM entry_index
       WHERE accession IS NOT NULL AND entry_type IS NOT NULL""",
)
def interpro_descriptions(t: Tables) -> DataFrame:
    return interpro.read_interpro_descriptions(t.spark, files.description_xml(t))


@query(
    "incremental_id_mapping",
    """WITH hits AS (SELECT p.tx_key AS protein_key, (SELECT arg_max(accession, ord) FROM mapping m WHERE m.refseq_id = p.protein_refseq_id AND m.refseq_id <> '') AS r,
         (SELECT arg_max(accession, ord) FROM mapping m WHERE m.enst_id = split_part(p.transcript_ensembl_id, '.', 1) AND m.enst_id <> '') AS e FROM proteins p)
       SELECT protein_key, coalesce(e, r) AS protein_interpro_id, coalesce(r <> e, FALSE) AS collision FROM hits WHERE r IS NOT NULL OR e IS NOT NULL""",
)
def incremental_id_mapping(t: Tables) -> DataFrame:
    """The mapping arrives file by file; the stream runs until nothing is left."""
    run = uuid.uuid4().hex
    hits, state = t.folder("stream", run, "hits"), t.folder("stream", run, "state")
    proteins = t.proteins.select(F.col("tx_key").alias("protein_key"), "protein_refseq_id", "transcript_ensembl_id")
    stream = idmap.stream_id_mapping(t.spark, files.mapping_files(t), proteins, hits, state)
    stream.awaitTermination()
    return idmap.current_ids(t.spark, hits)
