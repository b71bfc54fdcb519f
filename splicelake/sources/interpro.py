"""InterPro entries, matches and descriptions; UniProt id mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splicelake.sources.lines import line_order

# Spelling of member accessions per source.
MEMBER_SPELLING = {"smart": r"^sm(?=\d)", "pfam": r"^pf(?=\d)"}
MEMBER_SOURCES = ("pfam", "smart", "cdd", "tigrfams")

ENTRY_LIST = (
    "accession STRING, name STRING, source_database STRING, entry_type STRING, members STRING, go_terms STRING, "
    "rest STRING"
)


def read_entry_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY_LIST).option("sep", "|").option("quote", "\u0000").csv(path)


def entry_index(entries: DataFrame) -> DataFrame:
    """(source, ext_id, accession, entry_type) for every member accession and the entry itself.

    ``members`` reads ``db:a,b;db2:c``. Accessions are lower-cased, with ``sm``
    and ``pf`` spelled out.
    """
    lists = entries.select("accession", "entry_type", F.explode(F.split("members", ";")).alias("m"))
    items = lists.select(
        F.split_part("m", F.lit(":"), F.lit(1)).alias("source"),
        F.explode(F.split(F.lower(F.split_part("m", F.lit(":"), F.lit(2))), ",")).alias("ext_id"),
        "accession",
        "entry_type",
    ).filter(F.col("source").isin(*MEMBER_SOURCES) & (F.trim("ext_id") != ""))
    ext = F.trim("ext_id")
    for source, pattern in MEMBER_SPELLING.items():
        ext = F.when(F.col("source") == source, F.regexp_replace(F.trim("ext_id"), pattern, source)).otherwise(ext)
    own = entries.select(
        F.lit("interpro").alias("source"), F.col("accession").alias("ext_id"), "accession", "entry_type"
    )
    return items.withColumn("ext_id", ext).select("source", "ext_id", "accession", "entry_type").unionByName(own).distinct()


def entry_columns(index: DataFrame) -> DataFrame:
    """One row per entry with a sorted accession list per source."""
    sources = ["interpro", *MEMBER_SOURCES]
    lists = index.groupBy("accession", "entry_type").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("ext_id")))).alias(s) for s in sources]
    )
    return lists.select(
        "accession", "entry_type", *[F.nullif(F.array_join(s, "; "), F.lit("")).alias(s) for s in sources]
    )


ENTRY_JSON = (
    "struct<metadata:struct<accession:string,name:string,source_database:string,type:string,"
    "member_databases:map<string,map<string,string>>,go_terms:array<struct<identifier:string>>>>"
)


def flatten_entry_json(lines: DataFrame, value: str = "value") -> DataFrame:
    """Nested entry documents (one per row) as flat columns."""
    m = F.col("_e.metadata")
    return lines.withColumn("_e", F.from_json(value, ENTRY_JSON)).select(
        m.accession.alias("accession"),
        m["name"].alias("name"),
        m.source_database.alias("source_database"),
        m["type"].alias("entry_type"),
        F.coalesce(member_text(m.member_databases), F.lit("")).alias("members"),
        F.coalesce(F.array_join(F.transform(m.go_terms, lambda g: g.identifier), ","), F.lit("")).alias("go_terms"),
    )


def member_text(databases: Column) -> Column:
    """``db:a,b;db2:c`` from a map of databases to maps keyed by accession."""
    return F.array_join(
        F.transform(
            F.map_entries(databases),
            lambda d: F.concat(d["key"], F.lit(":"), F.array_join(F.map_keys(d["value"]), ",")),
        ),
        ";",
    )


def locations_text(locations: Column) -> Column:
    """``start..end`` of every fragment, comma-joined."""
    return F.array_join(
        F.flatten(
            F.transform(
                locations,
                lambda loc: F.transform(
                    loc["fragments"], lambda f: F.concat(f["start"].cast("string"), F.lit(".."), f["end"].cast("string"))
                ),
            )
        ),
        ",",
    )


MATCH_XML = (
    "_id STRING, match ARRAY<STRUCT<_id: STRING, _name: STRING, ipr: STRUCT<_id: STRING, _name: STRING>, "
    "lcn: ARRAY<STRUCT<_start: BIGINT, _end: BIGINT, _score: DOUBLE, _representative: STRING>>>>"
)
XML_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _xml_records(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row (``xml``) per element of this name.

    Files are cut at the closing tags, so a plain file is read by many tasks; an element without
    content may stand before the one that is closed. A gzip file is one split; its records
    are spread before they are parsed.
    """
    raw = spark.read.option("lineSep", f"</{tag}>").text(path)
    if any(f.endswith(".gz") for f in raw.inputFiles()):
        raw = raw.repartition(F.xxhash64("value"))
    inside = r"""(?:[^>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+"""
    element = rf"(?s)<{tag}(?=[\s/>]){inside}/>|<{tag}[\s>].*?</{tag}>"
    closed = F.concat("value", F.lit(f"</{tag}>"))
    return raw.select(F.explode(F.regexp_extract_all(closed, F.lit(element), F.lit(0))).alias("xml"))


def read_interpro_matches(spark: SparkSession, path: str) -> DataFrame:
    """Representative locations of all proteins: id, domain, span and score; a malformed record is an error."""
    proteins = _xml_records(spark, path, "protein").select(F.from_xml("xml", MATCH_XML, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    matches = proteins.select(F.col("_id").alias("protein_interpro_id"), F.explode("match").alias("m"))
    located = matches.select(
        "protein_interpro_id",
        F.when(F.col("m.ipr").isNotNull(), F.col("m.ipr._id")).otherwise(F.col("m._id")).alias("domain_id"),
        F.when(F.col("m.ipr").isNotNull(), F.col("m.ipr._name")).otherwise(F.col("m._name")).alias("domain_name"),
        F.explode("m.lcn").alias("l"),
    ).filter("l._representative = 'true'")
    return located.select(
        "protein_interpro_id",
        "domain_id",
        "domain_name",
        F.col("l._start").alias("start"),
        F.col("l._end").alias("end"),
        F.col("l._score").alias("score"),
    )


def representative_domains(matches: DataFrame, proteins: DataFrame, entries: DataFrame) -> DataFrame:
    """Matches of stored proteins with type and description of their entry."""
    known = proteins.select("protein_interpro_id").filter("protein_interpro_id IS NOT NULL")
    kept = matches.join(known, "protein_interpro_id", "left_semi")
    return attach_entry_meta(kept, entries)


def attach_entry_meta(domains: DataFrame, entries: DataFrame) -> DataFrame:
    meta = entries.select(F.col("accession").alias("domain_id"), "description", "type")
    return domains.join(meta, "domain_id", "left")


def read_interpro_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(accession, type, description) with markup removed and white space collapsed."""
    head = F.regexp_extract("xml", r"(?s)^(<interpro[^>]*>)", 1)
    body = F.regexp_extract("xml", r"(?s)<abstract[^>]*>(.*?)</abstract>", 1)
    flat = F.regexp_replace(body, r"<[^>]+>", " ")
    for entity, char in XML_ENTITIES.items():
        flat = F.replace(flat, F.lit(entity), F.lit(char))
    flat = F.trim(F.regexp_replace(flat, r"\s+", " "))
    return (
        _xml_records(spark, path, "interpro")
        .select(
            F.nullif(F.regexp_extract(head, r'\bid="([^"]*)"', 1), F.lit("")).alias("accession"),
            F.nullif(F.regexp_extract(head, r'\btype="([^"]*)"', 1), F.lit("")).alias("type"),
            F.nullif(flat, F.lit("")).alias("description"),
        )
        .filter("accession IS NOT NULL")
    )


def read_uniprot_idmap(spark: SparkSession, path: str, columns: int = 22) -> DataFrame:
    """Accession, RefSeq and Ensembl transcript columns of the headerless mapping file.

    Only these columns are parsed; empty cells stay empty strings.
    """
    schema = ", ".join(f"c{i} STRING" for i in range(columns))
    raw = spark.read.schema(schema).option("sep", "\t").option("quote", "\u0000").option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return raw.select(
        line_order().alias("ord"),
        F.col("c0").alias("accession"),
        F.coalesce("c3", F.lit("")).alias("refseq_id"),
        F.coalesce("c19", F.lit("")).alias("enst_id"),
    )
