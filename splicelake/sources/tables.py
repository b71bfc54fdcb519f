"""Tab- and pipe-separated inputs: domain tables, crosswalk, orthology, assemblies, genePred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.schemas import SPECIES
from splicelake.sources.lines import line_order

# The sources with a domain table and the accession spellings they use.
DOMAIN_SOURCES = ("pfam", "smart", "cdd", "tigrfams", "interpro")
SOURCES_MISSING = {"R_norvegicus": ("tigrfams",)}
ACCESSION_SPELLING = {"pf": "pfam", "sm": "smart"}
SPECIES_LABELS = {
    "Human": "H_sapiens",
    "Mouse": "M_musculus",
    "Rat": "R_norvegicus",
    "Norway rat": "R_norvegicus",
    "Zebrafish": "D_rerio",
    "Tropical clawed frog": "X_tropicalis",
}


def _joined_id(columns: list[str], entity: str) -> Column:
    joined, accession, version = f"{entity} stable ID version", f"{entity} stable ID", f"Version ({entity.lower()})"
    if joined in columns:
        return F.col(f"`{joined}`")
    if accession not in columns or version not in columns:
        raise ValueError(f"no '{joined}' column and no '{accession}' + '{version}' pair in {columns}")
    number = F.col(f"`{version}`").try_cast("double").cast("int")
    # Plain concat, so a row without accession or version gets null and is dropped later.
    return F.concat(F.col(f"`{accession}`"), F.lit("."), number.cast("string"))


def read_domain_table(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One domain table in either header layout, rows with any null still in."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    by_lower = {c.lower(): c for c in raw.columns}

    def own(field: str) -> Column:
        for label in (source, "tigrfam" if source == "tigrfams" else source):
            name = f"{label} {field}"
            if name in by_lower:
                return F.col(f"`{by_lower[name]}`")
        raise ValueError(f"no '{source} {field}' column in {raw.columns}")

    described = source == "interpro"
    return raw.select(
        _joined_id(raw.columns, "Transcript").alias("transcript_ensembl_id"),
        _joined_id(raw.columns, "Protein").alias("protein_ensembl_id"),
        own("id").alias("ext_id"),
        own("start").try_cast("bigint").alias("aa_start"),
        own("end").try_cast("bigint").alias("aa_end"),
        (own("short description") if described else F.lit(None).cast("string")).alias("name"),
        (own("description") if described else F.lit(None).cast("string")).alias("note"),
    )


def normalized_domains(table: DataFrame, source: str) -> DataFrame:
    needed = ["transcript_ensembl_id", "protein_ensembl_id", "ext_id", "aa_start", "aa_end"]
    if source == "interpro":
        needed += ["name", "note"]
    ext = F.lower("ext_id")
    for short, stored in ACCESSION_SPELLING.items():
        ext = F.regexp_replace(ext, rf"^{short}(?=\d)", stored)
    return table.na.drop(subset=needed).withColumn("ext_id", ext).withColumn("source", F.lit(source))


def read_domain_tables(spark: SparkSession, folder: str, species: str) -> tuple[DataFrame, DataFrame]:
    """(domains of all sources, protein↔transcript pairs from the interpro table)."""
    wanted = [s for s in DOMAIN_SOURCES if s not in SOURCES_MISSING.get(species, ())]
    tables = {s: read_domain_table(spark, f"{folder}/{species}.Domains.{s}.txt", s) for s in wanted}
    domains = reduce(DataFrame.unionByName, [normalized_domains(t, s) for s, t in tables.items()])
    pairs = tables["interpro"].select("protein_ensembl_id", "transcript_ensembl_id").na.drop().distinct()
    return domains, pairs


CROSSWALK_COLUMNS = (
    "tax_id INT, gene_id STRING, ens_gene STRING, refseq_tx STRING, ens_tx STRING, refseq_prot STRING, ens_prot STRING"
)


def read_id_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Crosswalk rows of all species as written; see ``operators.crosswalk`` for what they mean."""
    return (
        spark.read.schema(CROSSWALK_COLUMNS)
        .option("sep", "\t")
        .option("comment", "#")
        .csv(path)
        .withColumn("ord", line_order())
    )


def read_orthology_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All files ``<species>.<species>.orthology.txt``: (a_id, a_name, a_species, b_id, b_name, b_species).

    The columns are taken by position; rows with any null are dropped.
    """
    schema = "a_id STRING, a_name STRING, b_id STRING, b_name STRING, type STRING"
    raw = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("enforceSchema", True)
        .csv(f"{folder}/*.orthology.txt")
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    named = r"([^/.]+)\.([^/.]+)\.orthology\.txt"
    return (
        raw.drop("type")
        .na.drop()
        .select(
            "a_id",
            F.upper("a_name").alias("a_name"),
            F.regexp_extract("_path", named, 1).alias("a_species"),
            "b_id",
            F.upper("b_name").alias("b_name"),
            F.regexp_extract("_path", named, 2).alias("b_species"),
        )
    )


def latest_assembly(summary: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Published path of the assembly to use, per species.

    ``summary`` has ``species, accession, refseq_category, version_status,
    ftp_path, ord``. Reference genomes win over others, then the smallest path.
    When nothing is published, the newest entry of ``staged`` (species, name) that
    belongs to the flagged accession is taken, else the newest ``GCF_`` entry.
    """
    latest = summary.filter("version_status = 'latest'")
    plain = (F.col("refseq_category") != "reference genome").cast("int")
    path = F.when((F.col("ftp_path") != "na") & (F.col("ftp_path") != ""), F.col("ftp_path"))
    flagged = latest.groupBy("species").agg(
        F.min(F.when(path.isNotNull(), F.struct(plain.alias("p"), path.alias("path")))).alias("_published"),
        F.coalesce(
            F.max_by("accession", F.when(plain == 0, F.col("ord"))), F.min_by("accession", "ord")
        ).alias("accession"),
    )
    published = flagged.select("species", "accession", F.col("_published.path").alias("published"))
    if staged is None:
        return published.withColumn("path", F.col("published")).drop("published")
    names = published.select("species", F.substring_index("accession", ".", 1).alias("_stem")).join(staged, "species")
    newest = names.groupBy("species").agg(
        F.max(F.when(F.col("name").startswith(F.col("_stem")), F.col("name"))).alias("_own"),
        F.max(F.when(F.col("name").startswith("GCF_"), F.col("name"))).alias("_any"),
    )
    return published.join(newest, "species", "left").select(
        "species", "accession", F.coalesce("published", "_own", "_any").alias("path")
    )


def read_assembly_summary(spark: SparkSession, path: str, species: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("ord", line_order())
    cols = F.split("value", "\t")
    return lines.filter(~F.col("value").startswith("#") & (F.size(cols) > 19)).select(
        F.lit(species).alias("species"),
        cols[0].alias("accession"),
        cols[4].alias("refseq_category"),
        cols[10].alias("version_status"),
        cols[19].alias("ftp_path"),
        "ord",
    )


GENEPRED = (
    "name STRING, chromosome STRING, strand STRING, tx_start BIGINT, tx_end BIGINT, cds_start BIGINT, "
    "cds_end BIGINT, exon_count INT, exon_starts STRING, exon_ends STRING"
)


def read_genepred(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(GENEPRED).option("sep", "\t").option("comment", "#").csv(path)
        .withColumn("ord", line_order())
    )


def genepred_exons(table: DataFrame) -> DataFrame:
    """One row per exon of the first record of every name, in list order."""
    rest = [c for c in table.columns if c not in ("name", "ord")]
    first = table.groupBy("name").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("name", "r.*")

    def numbers(c: str) -> Column:
        return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("bigint"))

    zipped = first.withColumn("z", F.arrays_zip(numbers("exon_starts").alias("s"), numbers("exon_ends").alias("e")))
    return zipped.select(
        "name", "chromosome", "strand", "tx_start", "tx_end", "cds_start", "cds_end", F.posexplode("z").alias("pos", "x")
    ).select(
        "name",
        "chromosome",
        "strand",
        (F.col("pos") + 1).alias("order_in_transcript"),
        F.col("x.s").alias("genomic_start_tx"),
        F.col("x.e").alias("genomic_end_tx"),
    )


def with_symbol(transcripts: DataFrame, xref: DataFrame) -> DataFrame:
    """Symbol from a cross-reference table (name, gene_symbol); unknown names keep null."""
    return transcripts.join(xref, "name", "left")


def species_of_label(label: Column) -> Column:
    out = None
    for text, key in SPECIES_LABELS.items():
        out = F.when(label == text, key) if out is None else out.when(label == text, key)
    return F.coalesce(out, F.when(label.isin(*SPECIES), label))
