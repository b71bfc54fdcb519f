"""Annotation tables derived from the star schema the queries are checked on.

customer plays the gene, orders the transcript, lineitem the exon and the source
of domains. Each table is derived once per application, written to the shared
folder and read back, as the real tables are built once and queried many times.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.operators import exons as ex
from splicelake.operators.ordered import running_by_key
from splicelake.operators.orthology import orthology_pairs
from splicelake.session import scratch, shared_dir, shuffles_dropped

# Scalar formulas in the SQL both engines share.
FAMILY = "CAST(floor(c_custkey / 5.0) AS BIGINT)"
GENE = {
    "gene_key": "c_custkey",
    "gene_geneid_id": "CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST(c_custkey AS STRING) END",
    "gene_ensembl_id": "CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE concat('ENSG', lpad(CAST(c_custkey AS STRING), 11, '0')) END",
    "gene_symbol": f"CASE WHEN c_custkey % 7 = 0 THEN concat('LOC', CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 1 "
    f"THEN concat('Sym', CAST({FAMILY} AS STRING)) ELSE concat('SYM', CAST({FAMILY} AS STRING)) END",
    "synonyms": "CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE concat('ALT', CAST(CAST(floor(c_custkey / 3.0) AS BIGINT) AS STRING), "
    "'; SYN', CAST(c_custkey AS STRING)) END",
    "chromosome": "CAST(c_nationkey AS STRING)",
    "strand": "CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END",
    "specie": "CASE c_custkey % 5 WHEN 0 THEN 'H_sapiens' WHEN 1 THEN 'M_musculus' WHEN 2 THEN 'D_rerio' "
    "WHEN 3 THEN 'R_norvegicus' ELSE 'X_tropicalis' END",
    "family": FAMILY,
}
EXON_LEN = "(1 + CAST(l_quantity AS BIGINT) % 5) * 30"
EXON = {
    "tx_key": "tx_key",
    "gene_key": "gene_key",
    "order_in_transcript": "CAST(ord AS INT)",
    "genomic_start_tx": "CASE WHEN gene_key % 2 = 0 THEN gene_key * 100000 + run - 200 - len "
    "ELSE gene_key * 100000 + 90200 - run END",
    "genomic_end_tx": "CASE WHEN gene_key % 2 = 0 THEN gene_key * 100000 + run - 200 "
    "ELSE gene_key * 100000 + 90200 - run + len END",
}
TX = "CAST(tx_key AS STRING)"
REFSEQ_TX = f"concat(CASE WHEN tx_key % 6 = 0 THEN 'XM_' ELSE 'NM_' END, {TX}, '.', CAST(tx_key % 3 + 1 AS STRING))"
REFSEQ_PROT = f"concat(CASE WHEN tx_key % 6 = 0 THEN 'XP_' ELSE 'NP_' END, {TX}, '.', CAST(tx_key % 3 + 1 AS STRING))"
ENS_TX = f"concat('ENST', lpad({TX}, 11, '0'), '.1')"
ENS_PROT = f"concat('ENSP', lpad({TX}, 11, '0'), '.1')"
TRANSCRIPT = {
    "tx_key": "tx_key",
    "gene_key": "gene_key",
    "transcript_refseq_id": f"CASE WHEN tx_key % 5 = 0 THEN NULL ELSE {REFSEQ_TX} END",
    "transcript_ensembl_id": f"CASE WHEN tx_key % 5 = 1 THEN NULL ELSE {ENS_TX} END",
    "tx_start": "tx_start",
    "tx_end": "tx_end",
    "cds_start": "CASE WHEN tx_key % 17 = 0 THEN NULL ELSE tx_start + 10 + 40 * (tx_key % 3) END",
    "cds_end": "CASE WHEN tx_key % 17 = 0 THEN NULL ELSE tx_end - 10 END",
    "exon_count": "CAST(exon_count AS INT)",
    "gene_geneid_id": "gene_geneid_id",
    "gene_ensembl_id": "gene_ensembl_id",
    "protein_refseq_id": f"CASE WHEN tx_key % 5 = 0 OR tx_key % 13 = 0 THEN NULL ELSE {REFSEQ_PROT} END",
    "protein_ensembl_id": f"CASE WHEN tx_key % 5 = 1 OR tx_key % 13 = 0 THEN NULL ELSE {ENS_PROT} END",
    "canonical": "CAST(tx_key % 4 AS INT)",
}
PROTEIN = {
    "tx_key": "tx_key",
    "gene_key": "gene_key",
    "protein_refseq_id": "protein_refseq_id",
    "protein_ensembl_id": "protein_ensembl_id",
    "description": f"CASE WHEN tx_key % 9 = 0 THEN NULL ELSE concat('protein ', {TX}) END",
    "synonyms": f"CASE WHEN tx_key % 4 = 0 THEN concat('syn ', {TX}) ELSE NULL END",
    "length": "CAST(floor(coding_end / 3.0) AS BIGINT)",
    "transcript_refseq_id": "transcript_refseq_id",
    "transcript_ensembl_id": "transcript_ensembl_id",
}
TYPE_ID = "CAST(floor(gene_key / 50.0) AS BIGINT) * 40 + l_partkey % 40"
EXT_NO = "lpad(CAST(type_id * 2 + l_linenumber % 2 AS STRING), 9, '0')"
DOMAIN = {
    "tx_key": "tx_key",
    "type_id": "type_id",
    "aa_start": "aa_start",
    "aa_end": "aa_end",
    "ext_id": "concat(CASE type_id % 5 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cd' WHEN 3 THEN 'tigr' "
    f"ELSE 'IPR' END, {EXT_NO})",
    "cdd": "CASE WHEN type_id % 3 = 0 THEN concat('CDD', CAST(CAST(floor(type_id / 6.0) AS BIGINT) AS STRING)) ELSE NULL END",
    "name": "CASE WHEN type_id % 7 = 0 THEN NULL ELSE concat('dom_', CAST(CAST(floor(type_id / 4.0) AS BIGINT) AS STRING), "
    "'_', CAST(type_id % 4 AS STRING)) END",
}
REP_DOMAIN = {
    "protein_interpro_id": f"concat('P', {TX})",
    "domain_id": "ext_id",
    "domain_name": "CASE WHEN type_id % 11 = 0 THEN ' ' ELSE name END",
    "start": "aa_start",
    "end": "aa_end",
    "score": "CASE WHEN type_id % 4 = 0 THEN NULL ELSE (aa_end - aa_start) / 10.0e0 END",
}
ENTRY_NO = "CAST(floor(type_id / 10.0) AS BIGINT)"
ENTRY = {
    "accession": "concat('IPR', lpad(CAST(20 * k + 8 AS STRING), 9, '0'))",
    "entry_type": "CASE k % 4 WHEN 1 THEN 'repeat' WHEN 3 THEN 'family' ELSE 'domain' END",
}
MEMBER_SOURCE = "CASE type_id % 5 WHEN 0 THEN 'pfam' WHEN 1 THEN 'smart' WHEN 2 THEN 'cdd' ELSE 'tigrfams' END"
CROSSWALK = {
    "gene_id": "coalesce(gene_geneid_id, '-')",
    "ens_gene": "coalesce(gene_ensembl_id, '-')",
    "refseq_tx": f"CASE WHEN tx_key % 97 = 0 THEN '-' ELSE {REFSEQ_TX} END",
    "ens_tx": f"CASE WHEN tx_key % 7 = 1 OR tx_key % 97 = 0 THEN '-' ELSE {ENS_TX} END",
    "refseq_prot": REFSEQ_PROT,
    "ens_prot": f"CASE WHEN tx_key % 7 = 2 THEN '-' ELSE {ENS_PROT} END",
    "ord": "tx_key",
}
SOURCE_A = {
    "ord": "tx_key",
    "transcript_refseq_id": "transcript_refseq_id",
    "own_ensembl_id": f"CASE WHEN tx_key % 29 = 0 THEN concat('ENST', lpad(CAST(tx_key + 2 AS STRING), 11, '0'), '.1') "
    f"WHEN tx_key % 3 = 0 THEN {ENS_TX} ELSE NULL END",
    "gene_geneid_id": "gene_geneid_id",
    "protein_refseq_id": "protein_refseq_id",
    "length": "length",
    "canonical": "CAST(tx_key % 2 AS INT)",
}
SOURCE_B = {
    "ord": "tx_key",
    "transcript_ensembl_id": "transcript_ensembl_id",
    "gene_ensembl_id": "gene_ensembl_id",
    "protein_ensembl_id": "CASE WHEN length IS NULL THEN NULL ELSE protein_ensembl_id END",
    "length": "length + tx_key % 4",
    "canonical": "CAST(CASE WHEN tx_key % 8 < 4 THEN 2 ELSE 0 END AS INT)",
}
TRANSCRIPT_DUP = {
    "tx_key": "tx_key",
    "transcript_refseq_id": "CASE WHEN transcript_refseq_id IS NULL THEN NULL ELSE concat('NM_', CAST(tx_key - tx_key % 3 AS STRING)) END",
    "transcript_ensembl_id": "CASE WHEN transcript_ensembl_id IS NULL THEN NULL ELSE concat('ENST', CAST(tx_key - tx_key % 2 AS STRING)) END",
    "exon_count": "exon_count",
}
GENE_TERM = {
    "term": "CASE gene_key % 6 WHEN 0 THEN gene_symbol WHEN 1 THEN coalesce(gene_geneid_id, 'NONE') "
    "WHEN 2 THEN lower(coalesce(gene_ensembl_id, 'NONE')) WHEN 3 THEN concat('ALT', CAST(CAST(floor(gene_key / 3.0) AS BIGINT) AS STRING)) "
    "WHEN 4 THEN lower(concat('SYN', CAST(gene_key AS STRING))) ELSE concat('MISS', CAST(gene_key AS STRING)) END",
    "species": "CASE WHEN gene_key % 4 = 0 THEN 'all' ELSE specie END",
}
TRANSCRIPT_TERM = {
    "term": "CASE tx_key % 5 WHEN 0 THEN transcript_ensembl_id WHEN 1 THEN lower(transcript_refseq_id) "
    f"WHEN 2 THEN concat('NM_', {TX}) WHEN 3 THEN concat('ENST', lpad({TX}, 11, '0'), '.9') "
    f"ELSE coalesce(protein_refseq_id, concat('MISSP', {TX})) END",
    "species": "'all'",
}
MAP_FIRST = {
    "ord": "tx_key * 2",
    "accession": f"concat('P', {TX})",
    "refseq_id": "coalesce(protein_refseq_id, '')",
    "enst_id": f"CASE WHEN tx_key % 11 = 0 THEN '' ELSE concat('ENST', lpad({TX}, 11, '0')) END",
}
MAP_SECOND = {
    "ord": "tx_key * 2 + 1",
    "accession": f"concat('Q', {TX})",
    "refseq_id": "CASE WHEN tx_key % 8 = 0 THEN coalesce(protein_refseq_id, '') ELSE '' END",
    "enst_id": f"concat('ENST', lpad({TX}, 11, '0'))",
}
MAP_SECOND_ROWS = "tx_key % 11 = 0 OR tx_key % 8 = 0"


def spark_select(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in formulas.items()])


def _lines(t: "Tables") -> DataFrame:
    return (
        t.source("lineitem")
        .join(t.source("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumnsRenamed({"o_orderkey": "tx_key", "o_custkey": "gene_key"})
    )


def _exons(t: "Tables") -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    measured = _lines(t).select("tx_key", "gene_key", *order, F.expr(EXON_LEN).alias("len")).withColumns(
        {"_one": F.lit(1).cast("bigint"), "_step": F.col("len") + 200}
    )
    lines = t.source("lineitem").groupBy(F.col("l_orderkey").alias("tx_key")).agg(F.count("*").alias("_lines"))
    orders = t.source("orders").groupBy(F.col("o_orderkey").alias("tx_key")).agg(F.count("*").alias("_orders"))
    sizes = lines.join(orders, "tx_key").selectExpr("tx_key", "_lines * _orders AS n_rows")
    scanned = running_by_key(
        measured, ["tx_key"], order, {"ord": ("sum", "_one", "through"), "run": ("sum", "_step", "through")}, sizes
    )
    return spark_select(scanned, EXON)


def _transcripts(t: "Tables") -> DataFrame:
    spans = t.exons.groupBy("tx_key", "gene_key").agg(
        F.min("genomic_start_tx").alias("tx_start"),
        F.max("genomic_end_tx").alias("tx_end"),
        F.count("*").alias("exon_count"),
    )
    return spark_select(spans.join(t.genes.select("gene_key", "gene_geneid_id", "gene_ensembl_id"), "gene_key"), TRANSCRIPT)


def exon_sizes(t: "Tables") -> DataFrame:
    return t.exons.groupBy("tx_key").agg(F.count("*").alias("n_rows"))


def _proteins(t: "Tables") -> DataFrame:
    ends = t.cds.groupBy("tx_key").agg(F.max("abs_end_cds").alias("coding_end"))
    return spark_select(ex.coding_transcripts(t.transcripts).join(ends, "tx_key"), PROTEIN)


def _domains(t: "Tables") -> DataFrame:
    rows = _lines(t).selectExpr(
        "tx_key",
        "l_linenumber",
        f"{TYPE_ID} AS type_id",
        "1 + l_suppkey % 40 AS aa_start",
        "5 + l_suppkey % 40 + l_partkey % 30 AS aa_end",
    )
    kept = rows.join(t.proteins.select("tx_key", "length"), "tx_key").filter("aa_end <= length")
    return spark_select(kept, DOMAIN).distinct()


def _entries(t: "Tables") -> DataFrame:
    """Entry list with members written as ``db:A,B;db2:C`` in the spelling of the source."""
    base = t.domains.select("type_id", "ext_id").distinct().withColumn("k", F.expr(ENTRY_NO))
    raw = F.upper(F.regexp_replace(F.regexp_replace("ext_id", "^pfam", "pf"), "^smart", "sm"))
    lists = (
        base.filter("type_id % 5 <> 4 AND k % 6 <> 5")
        .groupBy("k", F.expr(MEMBER_SOURCE).alias("source"))
        .agg(F.array_join(F.array_sort(F.collect_set(raw)), ",").alias("ids"))
        .groupBy("k")
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source", "ids"))), ";").alias("members"))
    )
    entries = base.select("k").distinct().join(lists, "k", "left")
    return entries.selectExpr(*[f"{e} AS {n}" for n, e in ENTRY.items()], "coalesce(members, '') AS members")


def _orthology(t: "Tables") -> DataFrame:
    side = t.genes.filter("gene_ensembl_id IS NOT NULL").select("family", "gene_ensembl_id", "specie")
    a, b = (side.select("family", F.col("gene_ensembl_id").alias(f"{x}_id"), F.col("specie").alias(f"{x}_species")) for x in "ab")
    return a.join(b, "family").filter("a_species < b_species").drop("family")


def _terms(t: "Tables") -> DataFrame:
    return (
        spark_select(t.genes, GENE_TERM).unionByName(spark_select(t.transcripts, TRANSCRIPT_TERM)).filter("term IS NOT NULL").distinct()
    )


def _mapping(t: "Tables") -> DataFrame:
    return spark_select(t.proteins, MAP_FIRST).unionByName(spark_select(t.proteins.filter(MAP_SECOND_ROWS), MAP_SECOND))


BUILDERS: dict[str, Callable[["Tables"], DataFrame]] = {
    "genes": lambda t: spark_select(t.source("customer"), GENE),
    "exons": _exons,
    "transcripts": _transcripts,
    "cds": lambda t: ex.exons_to_cds(t.exons, t.transcripts, sizes=exon_sizes(t)),
    "proteins": _proteins,
    "domains": _domains,
    "rep_domains": lambda t: spark_select(t.domains.filter("type_id % 3 = 0 AND tx_key % 2 = 0"), REP_DOMAIN),
    "entries": _entries,
    "crosswalk_raw": lambda t: spark_select(t.transcripts.filter("tx_key % 7 <> 0"), CROSSWALK),
    "source_a": lambda t: spark_select(
        t.transcripts.join(t.proteins.select("tx_key", "length"), "tx_key", "left").filter(
            "transcript_refseq_id IS NOT NULL AND gene_geneid_id IS NOT NULL"
        ),
        SOURCE_A,
    ),
    "source_b": lambda t: spark_select(
        t.transcripts.join(t.proteins.select("tx_key", "length"), "tx_key", "left").filter(
            "transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL"
        ),
        SOURCE_B,
    ),
    "transcripts_dup": lambda t: spark_select(t.transcripts, TRANSCRIPT_DUP),
    "ortholog_rows": _orthology,
    "orthology": lambda t: orthology_pairs(t.ortholog_rows, t.genes),
    "search_terms": _terms,
    "mapping": _mapping,
}

_WRITTEN: dict[tuple[str, str, str], str] = {}
_BUILDING: defaultdict[tuple[str, str, str], Lock] = defaultdict(Lock)


class Tables:
    """The source tables of one data folder and everything derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self, *parts: str) -> str:
        tag = self.sf_dir.strip("/").replace("/", "_")
        return "/".join([shared_dir(self.spark), self.spark.sparkContext.applicationId, tag, *parts])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BUILDERS:
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        with _BUILDING[key]:
            if key not in _WRITTEN:
                path = self.folder(name)
                with scratch(self.spark):
                    table = BUILDERS[name](self)
                    with shuffles_dropped(self.spark):
                        table.write.mode("overwrite").option("compression", "zstd").parquet(path)
                _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    def prepare(self, at_once: int = 6) -> None:
        """Build all tables; those that do not depend on each other side by side, so small jobs fill the cluster together."""
        with ThreadPoolExecutor(at_once) as pool:
            for done in [pool.submit(getattr, self, name) for name in BUILDERS]:
                done.result()
