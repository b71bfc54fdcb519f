"""The store of all species, built species by species from the derived tables, and queries on what it holds."""

from __future__ import annotations

import uuid
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.operators import domains as dom
from splicelake.operators import search as se
from splicelake.operators import similarity as sim
from splicelake.operators import types as ty
from splicelake.plans.derived import Tables
from splicelake.plans.queries_search import TIERS_SQL
from splicelake.plans.queries_similarity import ALL_PAIRS, MATRIX_SQL, TOTALS_SQL
from splicelake.plans.registry import query
from splicelake.schemas import SPECIES
from splicelake.session import scratch, staged
from splicelake.sinks.store import Store

_BUILT: dict[tuple[str, str], Store] = {}
_LOCK = Lock()


def build_store(t: Tables, folder: str) -> Store:
    """Add the species one after the other; each numbers its domain types after those before.

    Every table is dealt to its species once, so a species reads only its own rows. The accessions that placed domains use are
    listed once for each species, so numbering types reads no events.
    """
    store = Store(t.spark, folder)
    with scratch(t.spark):
        transcripts = staged(t.transcripts.join(t.genes.select("gene_key", "specie"), "gene_key"), by="specie")
        owner = transcripts.select("tx_key", "specie")
        named = t.proteins.select("tx_key", "protein_refseq_id", "protein_ensembl_id").join(owner, "tx_key")
        placed = staged(dom.domain_events(t.domains, t.cds).drop("relation", "first_exon", "first_rank").join(named, "tx_key"), by="specie")
        exons = staged(t.cds.join(transcripts.select("tx_key", "specie", "transcript_refseq_id", "transcript_ensembl_id"), "tx_key"), by="specie")
        proteins = staged(t.proteins.join(owner.distinct(), "tx_key"), by="specie")
        component = F.format_string("%012d", "type_id").alias("component")
        used = staged(placed.select("specie", F.col("ext_id").alias("node"), component, "cdd", "name").distinct())
        for n, specie in enumerate(SPECIES):
            nodes = used.filter(F.col("specie").isin(list(SPECIES)[: n + 1])).select("node", "component").distinct()
            numbers = ty.number_types(nodes, store.type_ids()).withColumnRenamed("type_id", "_type")
            facts = staged(
                used.filter(F.col("specie") == specie).select(F.col("node").alias("ext_id"), "cdd", "name").distinct().join(numbers, "ext_id")
                .selectExpr("ext_id", "CAST(NULL AS STRING) AS accession", "cdd", "name", "CAST(NULL AS STRING) AS note", "_type AS type_id")
            )
            events = placed.filter(F.col("specie") == specie).drop("specie", "cdd", "name", "type_id")
            store.add(
                specie,
                {
                    "genes": t.genes.filter(F.col("specie") == specie),
                    "transcripts": transcripts.filter(F.col("specie") == specie),
                    "transcript_exon": exons.filter(F.col("specie") == specie).drop("specie"),
                    "proteins": proteins.filter(F.col("specie") == specie).drop("specie"),
                    "domain_event": events.join(facts.select("ext_id", "type_id").distinct(), "ext_id"),
                },
                facts,
            )
    return store


def store_of(t: Tables) -> Store:
    """The application's store over one data folder, built when first asked for."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    with _LOCK:
        if key not in _BUILT:
            _BUILT[key] = build_store(t, t.folder("store", uuid.uuid4().hex))
        return _BUILT[key]


PLACED_SQL = "placed AS (SELECT r.*, t.gene_key, specie FROM relation r JOIN transcripts t ON t.tx_key = r.tx_key JOIN genes g ON g.gene_key = t.gene_key)"
ORDER_SQL = "CASE specie " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SPECIES)) + " END"


@query(
    "merged_store_counts",
    f"""WITH {PLACED_SQL} SELECT g.specie, count(*) AS n_genes,
         (SELECT count(*) FROM transcripts t JOIN genes x ON x.gene_key = t.gene_key WHERE x.specie = g.specie) AS n_transcripts,
         (SELECT count(*) FROM cds t JOIN genes x ON x.gene_key = t.gene_key WHERE x.specie = g.specie) AS n_exons,
         (SELECT count(*) FROM proteins t JOIN genes x ON x.gene_key = t.gene_key WHERE x.specie = g.specie) AS n_proteins,
         (SELECT count(*) FROM placed p WHERE p.specie = g.specie) AS n_events,
         (SELECT count(DISTINCT type_id) FROM placed p WHERE p.specie = g.specie) AS n_types_used,
         (SELECT count(DISTINCT type_id) FROM placed p) AS n_types_stored
       FROM genes g GROUP BY g.specie""",
)
def merged_store_counts(t: Tables) -> DataFrame:
    """Rows per species of every table, and the types used by it and stored for all."""
    store = store_of(t)

    def per(name: str, out: str) -> DataFrame:
        return store.load(name).groupBy("specie").agg(F.count("*").alias(out))

    counts = per("genes", "n_genes")
    for name, out in (("transcripts", "n_transcripts"), ("transcript_exon", "n_exons"), ("proteins", "n_proteins"), ("domain_event", "n_events")):
        counts = counts.join(per(name, out), "specie")
    used = store.load("domain_event").groupBy("specie").agg(F.countDistinct("type_id").alias("n_types_used"))
    stored = store.load("domain_type").count()
    return counts.join(used, "specie").withColumn("n_types_stored", F.lit(stored).cast("long"))


@query(
    "merged_store_types",
    f"""WITH {PLACED_SQL}, firsts AS (SELECT type_id AS old, min({ORDER_SQL}) AS first, count(DISTINCT specie) AS n_species FROM placed GROUP BY 1),
       ids AS (SELECT old, n_species, row_number() OVER (ORDER BY first, old) AS type_id FROM firsts),
       called AS (SELECT type_id AS old, arg_min(name, row(length(name), name)) AS name, string_agg(DISTINCT cdd, '; ' ORDER BY cdd) AS cdd_id FROM placed GROUP BY 1)
       SELECT type_id, name, cdd_id, n_species FROM ids JOIN called USING (old)""",
)
def merged_store_types(t: Tables) -> DataFrame:
    """Types with the id that the first species to use them gave, and their attributes over all species."""
    store = store_of(t)
    spread = store.load("domain_event").groupBy("type_id").agg(F.countDistinct("specie").alias("n_species"))
    return store.load("domain_type").select("type_id", "name", "cdd_id").join(spread, "type_id")


@query(
    "merged_store_search",
    f"""WITH {TIERS_SQL}, every AS (SELECT * FROM hits UNION ALL SELECT term, 4, gene_key, specie FROM close_hits),
       chosen AS (SELECT * FROM every e WHERE tier = (SELECT min(tier) FROM every x WHERE x.term = e.term))
       SELECT c.term, s.species, tier, gene_geneid_id, gene_ensembl_id, c.specie, tier < 4 AS is_exact FROM chosen c JOIN search_terms s ON s.term = c.term
       JOIN genes g ON g.gene_key = c.gene_key WHERE s.species = 'all' OR s.species = c.specie""",
)
def merged_store_search(t: Tables) -> DataFrame:
    """The batch search over the store's genes and transcripts."""
    stored = store_of(t).operator_tables()
    ids = stored["genes"].select("gene_key", "gene_geneid_id", "gene_ensembl_id")
    return se.search(t.search_terms, stored["genes"], stored["transcripts"]).join(ids, "gene_key").drop("gene_key")


@query(
    "merged_store_document",
    f"""WITH {PLACED_SQL}, x AS (SELECT t.*, g.specie FROM transcripts t JOIN genes g ON g.gene_key = t.gene_key)
       SELECT x.specie, x.transcript_refseq_id, x.transcript_ensembl_id, (SELECT count(*) FROM cds c WHERE c.tx_key = x.tx_key) AS n_exons,
         (SELECT CAST(sum(abs_end_cds) AS BIGINT) FROM cds c WHERE c.tx_key = x.tx_key) AS sum_cds_ends, p.length AS protein_length,
         (SELECT count(*) FROM placed d WHERE d.tx_key = x.tx_key) AS n_domains FROM x LEFT JOIN proteins p ON p.tx_key = x.tx_key""",
)
def merged_store_document(t: Tables) -> DataFrame:
    """Documents of the stored genes, a row for each transcript."""
    tables = store_of(t).operator_tables()
    docs = se.gene_document(**tables).filter("tx_key IS NOT NULL")
    ends = F.aggregate("exons", F.lit(0).cast("long"), lambda acc, e: acc + e["abs_end_cds"])
    return docs.select(
        "specie", "transcript_refseq_id", "transcript_ensembl_id", F.size("exons").cast("long").alias("n_exons"), ends.alias("sum_cds_ends"),
        F.col("protein.length").alias("protein_length"), F.size("domains").cast("long").alias("n_domains"),
    )


@query(
    "merged_store_similarity",
    f"""WITH {ALL_PAIRS}, {MATRIX_SQL}, {TOTALS_SQL} SELECT gene_geneid_id, gene_ensembl_id, specie, count(DISTINCT t.tx_key) AS n_transcripts, round(avg(x.similarity), 7) AS similarity
       FROM transcripts t JOIN (SELECT gene_key AS gk, specie FROM genes) ON gk = t.gene_key LEFT JOIN totals x ON x.a_tx = t.tx_key GROUP BY ALL""",
)
def merged_store_similarity(t: Tables) -> DataFrame:
    """Gene similarity computed from the stored exons and domains alone."""
    tables = store_of(t).operator_tables()
    exons, types = sim.exon_features(tables["cds"], tables["domains"])
    scores = sim.gene_similarity(tables["transcripts"], exons, types).withColumn("similarity", F.round("similarity", 7))
    return tables["genes"].select("gene_key", "gene_geneid_id", "gene_ensembl_id", "specie").join(scores, "gene_key").drop("gene_key")
