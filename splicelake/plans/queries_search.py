"""Gene search, documents and orthology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators import orthology as orth
from splicelake.operators import search as se
from splicelake.plans.derived import Tables
from splicelake.plans.registry import query
from splicelake.schemas import SPECIES

TIERS_SQL = """gk AS (SELECT gene_key, specie, unnest([upper(gene_symbol), upper(gene_geneid_id), upper(gene_ensembl_id)]) AS key FROM genes),
       tk AS (SELECT gene_key, unnest([upper(transcript_refseq_id), upper(transcript_ensembl_id), upper(protein_refseq_id), upper(protein_ensembl_id)]) AS key FROM transcripts),
       asked AS (SELECT DISTINCT term, upper(term) AS key, split_part(upper(term), '.', 1) AS bare FROM search_terms),
       lens AS (SELECT DISTINCT length(bare) AS n FROM asked WHERE bare <> ''),
       cuts AS (SELECT DISTINCT gene_key, substr(key, 1, n) AS cut FROM tk JOIN lens ON n <= length(key)),
       hits AS (SELECT term, 1 AS tier, gene_key, specie FROM asked JOIN gk ON gk.key = asked.key
         UNION SELECT term, 2, g.gene_key, specie FROM asked JOIN tk ON tk.key = asked.key JOIN genes g ON g.gene_key = tk.gene_key
         UNION SELECT term, 3, g.gene_key, specie FROM asked JOIN cuts ON cut = bare JOIN genes g ON g.gene_key = cuts.gene_key),
       syn AS (SELECT gene_key, specie, gene_symbol, unnest(string_split(lower(synonyms), '; ')) AS key FROM genes WHERE synonyms IS NOT NULL),
       close_hits AS (SELECT DISTINCT term, gene_key, specie, gene_symbol FROM asked JOIN syn ON syn.key = lower(term))"""


@query(
    "find_genes",
    f"""WITH {TIERS_SQL} SELECT term, tier, gene_key, specie FROM hits h
       WHERE tier = (SELECT min(tier) FROM hits x WHERE x.term = h.term)""",
)
def find_genes(t: Tables) -> DataFrame:
    return se.find_genes(t.search_terms, t.genes, t.transcripts)


@query("close_genes", f"WITH {TIERS_SQL} SELECT term, gene_key, specie, gene_symbol FROM close_hits")
def close_genes(t: Tables) -> DataFrame:
    return se.close_genes(t.search_terms, t.genes)


@query(
    "search",
    f"""WITH {TIERS_SQL}, every AS (SELECT * FROM hits UNION ALL SELECT term, 4, gene_key, specie FROM close_hits),
       chosen AS (SELECT * FROM every e WHERE tier = (SELECT min(tier) FROM every x WHERE x.term = e.term))
       SELECT c.term, s.species, tier, gene_key, specie, tier < 4 AS is_exact FROM chosen c JOIN search_terms s ON s.term = c.term
       WHERE s.species = 'all' OR s.species = specie""",
)
def search(t: Tables) -> DataFrame:
    return se.search(t.search_terms, t.genes, t.transcripts)


@query(
    "search_species_first",
    f"""WITH {TIERS_SQL}, every AS (SELECT h.*, s.species FROM (SELECT * FROM hits UNION ALL SELECT term, 4, gene_key, specie FROM close_hits) h
         JOIN search_terms s ON s.term = h.term WHERE s.species = 'all' OR s.species = specie)
       SELECT term, species, tier, gene_key, specie, tier < 4 AS is_exact FROM every e
       WHERE tier = (SELECT min(tier) FROM every x WHERE x.term = e.term AND x.species = e.species)""",
)
def search_species_first(t: Tables) -> DataFrame:
    return se.search(t.search_terms, t.genes, t.transcripts, species_first=True)


@query(
    "did_you_mean",
    f"""WITH {TIERS_SQL} SELECT term, count(*) AS n_genes, string_agg(DISTINCT gene_symbol, ', ' ORDER BY gene_symbol) AS symbols
       FROM close_hits GROUP BY term HAVING count(*) > 1""",
)
def did_you_mean(t: Tables) -> DataFrame:
    return se.did_you_mean(t.search_terms, t.genes)


@query(
    "did_you_mean_items",
    f"""WITH {TIERS_SQL}, several AS (SELECT term, count(*) AS n_genes FROM close_hits GROUP BY term HAVING count(*) > 1)
       SELECT term, n_genes, row_number() OVER (PARTITION BY term ORDER BY gene_symbol) AS position, gene_symbol AS item
       FROM (SELECT DISTINCT term, n_genes, gene_symbol FROM close_hits JOIN several USING (term) WHERE gene_symbol IS NOT NULL)""",
)
def did_you_mean_items(t: Tables) -> DataFrame:
    return se.did_you_mean_items(t.search_terms, t.genes)


COUNTS_SQL = """SELECT g.gene_key, gene_symbol, specie,
         (SELECT count(*) FROM transcripts x WHERE x.gene_key = g.gene_key) AS n_transcripts,
         (SELECT count(*) FROM cds x WHERE x.gene_key = g.gene_key) AS n_transcript_exons,
         (SELECT count(*) FROM (SELECT DISTINCT gene_key AS k, genomic_start_tx, genomic_end_tx FROM cds) x WHERE x.k = g.gene_key) AS n_gene_exons,
         (SELECT count(*) FROM proteins x WHERE x.gene_key = g.gene_key) AS n_proteins,
         (SELECT count(*) FROM domains d JOIN transcripts x ON d.tx_key = x.tx_key WHERE x.gene_key = g.gene_key) AS n_domains FROM genes g"""


@query("gene_document_counts", COUNTS_SQL)
def gene_document_counts(t: Tables) -> DataFrame:
    return se.document_counts(t.genes, t.transcripts, t.cds, t.proteins, t.domains)


@query("gene_document", COUNTS_SQL)
def gene_document(t: Tables) -> DataFrame:
    """Gene documents, read back as the number of children on each level."""
    docs = se.gene_document(t.genes, t.transcripts, t.cds, t.proteins, t.domains)
    counted = docs.groupBy("gene_key", "gene_symbol", "specie").agg(
        F.count("tx_key").alias("n_transcripts"),
        F.sum(F.coalesce(F.size("exons"), F.lit(0))).alias("n_transcript_exons"),
        F.count("protein").alias("n_proteins"),
        F.sum(F.coalesce(F.size("domains"), F.lit(0))).alias("n_domains"),
    )
    exons = se.gene_exons(t.cds).groupBy("gene_key").agg(F.count("*").alias("n_gene_exons"))
    return counted.join(exons, "gene_key", "left").na.fill(0, ["n_gene_exons"])


@query(
    "gene_document_items",
    """WITH x AS (SELECT t.* FROM transcripts t JOIN genes USING (gene_key))
       SELECT gene_key, tx_key, 'transcript' AS kind, tx_start AS low, tx_end AS high, transcript_refseq_id AS name FROM x
       UNION ALL SELECT x.gene_key, tx_key, 'exon', genomic_start_tx, genomic_end_tx, CAST(order_in_transcript AS VARCHAR) FROM x JOIN cds USING (tx_key)
       UNION ALL SELECT x.gene_key, tx_key, 'protein', 1, length, p.protein_refseq_id FROM x JOIN proteins p USING (tx_key)
       UNION ALL SELECT gene_key, tx_key, 'domain', aa_start, aa_end, ext_id FROM x JOIN domains USING (tx_key)""",
)
def gene_document_items(t: Tables) -> DataFrame:
    """Every transcript, exon, protein and domain that the gene documents hold."""
    docs = se.gene_document(t.genes, t.transcripts, t.cds, t.proteins, t.domains).filter("tx_key IS NOT NULL")

    def items(rows: DataFrame, kind: str, low: str, high: str, name: str) -> DataFrame:
        return rows.selectExpr("gene_key", "tx_key", f"'{kind}' AS kind", f"CAST({low} AS BIGINT) AS low", f"CAST({high} AS BIGINT) AS high", f"CAST({name} AS STRING) AS name")

    exons = docs.select("gene_key", "tx_key", F.explode("exons").alias("e"))
    domains = docs.select("gene_key", "tx_key", F.explode("domains").alias("d"))
    return (
        items(docs, "transcript", "tx_start", "tx_end", "transcript_refseq_id")
        .unionByName(items(exons, "exon", "e.genomic_start_tx", "e.genomic_end_tx", "e.order_in_transcript"))
        .unionByName(items(docs.filter("protein IS NOT NULL"), "protein", "1", "protein.length", "protein.protein_refseq_id"))
        .unionByName(items(domains, "domain", "d.aa_start", "d.aa_end", "d.ext_id"))
    )


# --- orthology ----------------------------------------------------------------


@query("orthology_pairs", "SELECT * FROM orthology")
def orthology_pairs(t: Tables) -> DataFrame:
    return orth.orthology_pairs(t.ortholog_rows, t.genes)


@query(
    "collapse_orthology",
    """SELECT a_ensembl_id, string_agg(DISTINCT a_genesymb, ', ' ORDER BY a_genesymb) AS a_genesymb, string_agg(DISTINCT a_species, ', ' ORDER BY a_species) AS a_species,
       b_ensembl_id, string_agg(DISTINCT b_genesymb, ', ' ORDER BY b_genesymb) AS b_genesymb, string_agg(DISTINCT b_species, ', ' ORDER BY b_species) AS b_species
       FROM (SELECT * FROM orthology UNION ALL SELECT a_ensembl_id, a_genesymb || 'X', a_species, b_ensembl_id, b_genesymb, b_species FROM orthology)
       GROUP BY a_ensembl_id, b_ensembl_id""",
)
def collapse_orthology(t: Tables) -> DataFrame:
    """Every pair under two spellings of its first symbol."""
    pairs = t.orthology
    respelled = pairs.withColumn("a_genesymb", F.concat("a_genesymb", F.lit("X")))
    return orth.collapse_orthology(pairs.unionByName(respelled))


FLIP_SQL = """flip AS (SELECT a_ensembl_id AS ensembl_id, a_genesymb AS symbol, a_species AS species, b_ensembl_id AS other_id, b_genesymb AS other_symbol, b_species AS other_species FROM orthology
         UNION ALL SELECT b_ensembl_id, b_genesymb, b_species, a_ensembl_id, a_genesymb, a_species FROM orthology)"""


@query(
    "ortholog_wide",
    f"WITH {FLIP_SQL} SELECT ensembl_id, species, "
    + ", ".join(
        f"coalesce(string_agg(DISTINCT other_symbol, '; ' ORDER BY other_symbol) FILTER (other_species = '{s}'), NULL) AS {s}" for s in SPECIES
    )
    + " FROM flip GROUP BY ensembl_id, species",
)
def ortholog_wide(t: Tables) -> DataFrame:
    return orth.ortholog_wide(t.orthology, list(SPECIES))


@query(
    "symbol_match",
    """WITH keys AS (SELECT upper(gene_symbol) AS term FROM genes UNION SELECT upper(gene_ensembl_id) FROM genes WHERE gene_ensembl_id IS NOT NULL)
       SELECT term, gene_symbol AS match_symbol, specie AS match_species FROM keys JOIN genes ON upper(gene_symbol) = term OR upper(gene_ensembl_id) = term""",
)
def symbol_match(t: Tables) -> DataFrame:
    """Every symbol and Ensembl id asked for once, with the genes of all species that carry it."""
    keys = t.genes.select(F.explode(F.array(F.upper("gene_symbol"), F.upper("gene_ensembl_id"))).alias("term")).filter("term IS NOT NULL")
    return orth.symbol_matches(keys, t.genes)


ORTHOLOG_SQL = f"""{FLIP_SQL}, asked AS (SELECT DISTINCT gene_symbol AS term, specie AS species FROM genes UNION
           SELECT DISTINCT 'SYN' || gene_key, specie FROM genes UNION SELECT DISTINCT lower(gene_ensembl_id), specie FROM genes WHERE gene_ensembl_id IS NOT NULL),
       fk AS (SELECT DISTINCT upper(ensembl_id) AS key, * FROM flip UNION SELECT upper(symbol), * FROM flip),
       syn AS (SELECT gene_key, specie, gene_symbol, unnest(string_split(lower(synonyms), '; ')) AS key FROM genes WHERE synonyms IS NOT NULL),
       through AS (SELECT term, species, arg_max(gene_symbol, gene_key) AS found FROM asked JOIN syn ON syn.key = lower(term) AND specie = species GROUP BY term, species),
       rows_found AS (SELECT term, a.species, ensembl_id, other_id, other_symbol, other_species FROM asked a JOIN fk ON fk.key = upper(term) AND fk.species = a.species
         UNION SELECT term, h.species, ensembl_id, other_id, other_symbol, other_species FROM through h JOIN fk ON fk.key = upper(found) AND fk.species = h.species),
       sm AS (SELECT DISTINCT term, a.species, gene_symbol, specie FROM asked a JOIN (SELECT upper(gene_symbol) AS key, gene_symbol, specie FROM genes
           UNION SELECT upper(gene_ensembl_id), gene_symbol, specie FROM genes) g ON g.key = upper(term)
         WHERE NOT EXISTS (SELECT 1 FROM through h WHERE h.term = a.term AND h.species = a.species)
           OR EXISTS (SELECT 1 FROM rows_found r WHERE r.term = a.term AND r.species = a.species)),
       answers AS (SELECT term, species, 'orthology' AS kind, ensembl_id, other_id AS other_ensembl_id, other_symbol, other_species FROM rows_found
         UNION ALL SELECT term, species, 'symbol', NULL, NULL, gene_symbol, specie FROM sm)"""


def _ortholog_terms(t: Tables) -> DataFrame:
    """Every gene asked for by symbol, by synonym and by Ensembl id."""
    g = t.genes
    return (
        g.select(F.col("gene_symbol").alias("term"), F.col("specie").alias("species"))
        .unionByName(g.select(F.concat(F.lit("SYN"), F.col("gene_key").cast("string")).alias("term"), F.col("specie").alias("species")))
        .unionByName(g.filter("gene_ensembl_id IS NOT NULL").select(F.lower("gene_ensembl_id").alias("term"), F.col("specie").alias("species")))
    )


@query("orthologs", f"WITH {ORTHOLOG_SQL} SELECT * FROM answers")
def orthologs(t: Tables) -> DataFrame:
    return orth.orthologs(_ortholog_terms(t), t.orthology, t.genes)


@query(
    "ortholog_options",
    f"""WITH {ORTHOLOG_SQL}, o1 AS (SELECT DISTINCT term, species, other_species AS target, other_symbol AS option FROM answers WHERE kind = 'orthology' AND species <> other_species),
       o2 AS (SELECT DISTINCT term, species, other_species AS target, other_symbol AS option FROM answers WHERE kind = 'symbol' AND species <> other_species),
       heads AS (SELECT term, species, target, min(option) AS head FROM o2 GROUP BY ALL)
       SELECT term, species, target, 'orthology' AS source, option FROM o1 UNION ALL SELECT o2.term, o2.species, o2.target, 'symbol', o2.option FROM o2 JOIN heads h
         ON h.term = o2.term AND h.species = o2.species AND h.target = o2.target
       WHERE NOT EXISTS (SELECT 1 FROM o1 WHERE o1.term = h.term AND o1.species = h.species AND o1.target = h.target AND upper(o1.option) = upper(head))""",
)
def ortholog_options(t: Tables) -> DataFrame:
    return orth.ortholog_options(orth.orthologs(_ortholog_terms(t), t.orthology, t.genes)).select(
        "term", "species", "target", "source", "option"
    )


@query(
    "compare_species",
    f"""WITH docs AS ({COUNTS_SQL}), p AS (SELECT a.gene_key AS a_key, b.gene_key AS b_key FROM orthology JOIN genes a ON a.gene_ensembl_id = a_ensembl_id JOIN genes b ON b.gene_ensembl_id = b_ensembl_id)
       SELECT a_key, b_key, a.specie AS a_specie, b.specie AS b_specie, a.n_transcripts AS a_n_transcripts, b.n_transcripts AS b_n_transcripts,
         a.n_gene_exons AS a_n_gene_exons, b.n_gene_exons AS b_n_gene_exons, a.n_domains AS a_n_domains, b.n_domains AS b_n_domains
       FROM p JOIN docs a ON a.gene_key = a_key JOIN docs b ON b.gene_key = b_key""",
)
def compare_species(t: Tables) -> DataFrame:
    docs = se.document_counts(t.genes, t.transcripts, t.cds, t.proteins, t.domains).select(
        "gene_key", "specie", "n_transcripts", "n_gene_exons", "n_domains"
    )
    return orth.compare_species(_ortholog_keys(t), docs)


@query(
    "compare_species_documents",
    """WITH p AS (SELECT a.gene_key AS a_key, b.gene_key AS b_key FROM orthology JOIN genes a ON a.gene_ensembl_id = a_ensembl_id JOIN genes b ON b.gene_ensembl_id = b_ensembl_id),
       sides AS (SELECT a_key, b_key, 'a' AS side, a_key AS gene_key FROM p UNION ALL SELECT a_key, b_key, 'b', b_key FROM p),
       e AS (SELECT tx_key, string_agg(genomic_start_tx || '-' || genomic_end_tx, ' ' ORDER BY order_in_transcript) AS exons FROM cds GROUP BY 1),
       d AS (SELECT tx_key, string_agg(aa_start || '-' || aa_end || ':' || ext_id, ' ' ORDER BY aa_start, aa_end, type_id, ext_id) AS domains FROM domains GROUP BY 1)
       SELECT a_key, b_key, side, g.gene_symbol, g.specie, x.tx_key, x.transcript_refseq_id, p.length AS protein_length, coalesce(exons, '') AS exons, coalesce(domains, '') AS domains
       FROM sides s JOIN genes g ON g.gene_key = s.gene_key LEFT JOIN transcripts x ON x.gene_key = s.gene_key LEFT JOIN proteins p ON p.tx_key = x.tx_key
       LEFT JOIN e ON e.tx_key = x.tx_key LEFT JOIN d ON d.tx_key = x.tx_key""",
)
def compare_species_documents(t: Tables) -> DataFrame:
    """The documents of both genes, with their exons and domains written out in order."""
    docs = se.gene_document(t.genes, t.transcripts, t.cds, t.proteins, t.domains)
    exons = F.transform("exons", lambda e: F.concat_ws("-", e["genomic_start_tx"], e["genomic_end_tx"]))
    domains = F.transform("domains", lambda d: F.concat(d["aa_start"].cast("string"), F.lit("-"), d["aa_end"].cast("string"), F.lit(":"), d["ext_id"]))
    return orth.compare_documents(_ortholog_keys(t), docs).select(
        "a_key", "b_key", "side", "gene_symbol", "specie", "tx_key", "transcript_refseq_id", F.col("protein.length").alias("protein_length"),
        F.coalesce(F.array_join(exons, " "), F.lit("")).alias("exons"), F.coalesce(F.array_join(domains, " "), F.lit("")).alias("domains"),
    )


def _ortholog_keys(t: Tables) -> DataFrame:
    ids = t.genes.select("gene_key", "gene_ensembl_id")
    keyed = (
        t.orthology
        .join(ids.select(F.col("gene_key").alias("a_key"), F.col("gene_ensembl_id").alias("a_ensembl_id")), "a_ensembl_id")
        .join(ids.select(F.col("gene_key").alias("b_key"), F.col("gene_ensembl_id").alias("b_ensembl_id")), "b_ensembl_id")
    )
    return keyed.select("a_key", "b_key")
