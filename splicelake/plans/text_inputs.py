"""Source files written from the derived tables, so the readers run on whole tables.

Each function writes one kind of file below the shared folder once per
application and returns its path.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from splicelake.plans.derived import Tables
from splicelake.sources.first_lines import open_uri, opened_uri

_DONE: dict[tuple[str, str, str], str] = {}


def _once(t: Tables, name: str, write) -> str:
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _DONE:
        path = t.folder("text", name)
        write(path)
        _DONE[key] = path
    return _DONE[key]


def _write_lines(parts: list[DataFrame], path: str) -> None:
    """Lines of all parts, compressed as annotation is published; each task's file is one split of the reader."""
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").option("compression", "gzip").text(path)


def _files_of_their_own(rows: DataFrame, by: str, path: str) -> None:
    """The texts in ``value``, one file for each value of ``by``, in ``part=<task>/<by>=<value>``.

    Tasks write the files where they stay: Spark's writer makes several calls for each file and lists and moves all of them
    in the end. A task that is run again writes the same names. Where pyarrow can't open the file system, Spark's writer is taken.
    """
    root = opened_uri(rows.sparkSession, path)
    if root is None:
        rows.repartition(by).write.mode("overwrite").partitionBy(by).text(path)
        return

    def write(part: Iterator[Row]) -> None:
        system, base = open_uri(root)
        folder = f"{base}/part={TaskContext.get().partitionId()}"
        for value, same in groupby(part, key=lambda r: r[by]):
            at = f"{folder}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
            system.create_dir(at)
            with system.open_output_stream(f"{at}/lines.txt") as file:
                for r in same:
                    file.write(f"{r['value'] or ''}\n".encode())

    rows.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)  # an empty folder, without earlier files
    rows.repartition(by).sortWithinPartitions(by).foreachPartition(write)


def _gff(df: DataFrame, seqid: str, kind: str, start: str, end: str, strand: str, attributes: str) -> DataFrame:
    cells = [seqid, "'src'", f"'{kind}'", f"CAST({start} AS STRING)", f"CAST({end} AS STRING)", "'.'", strand, "'.'", attributes]
    return df.selectExpr(f"concat_ws('\t', {', '.join(cells)}) AS value")


def _located(t: Tables) -> DataFrame:
    g = t.genes.select("gene_key", "gene_symbol", "synonyms", "chromosome", "strand")
    return t.transcripts.join(g, "gene_key")


def _coding_segments(t: Tables, tx: DataFrame) -> DataFrame:
    return t.cds.filter("abs_start_cds > 0").select("tx_key", "genomic_start_tx", "genomic_end_tx").join(tx, "tx_key").selectExpr(
        "*",
        "greatest(genomic_start_tx, coalesce(cds_start, tx_start)) + 1 AS seg_start",
        "least(genomic_end_tx, coalesce(cds_end, tx_end)) AS seg_end",
    )


def ensembl_gff(t: Tables) -> str:
    def write(path: str) -> None:
        tx = _located(t).filter("transcript_ensembl_id IS NOT NULL AND gene_ensembl_id IS NOT NULL").withColumn(
            "bare", F.substring_index("transcript_ensembl_id", ".", 1)
        )
        genes = tx.groupBy("gene_ensembl_id", "gene_symbol", "chromosome", "strand").agg(
            (F.min("tx_start") + 1).alias("s"), F.max("tx_end").alias("e")
        )
        exons = t.exons.select("tx_key", "order_in_transcript", "genomic_start_tx", "genomic_end_tx").join(tx, "tx_key")
        segments = _coding_segments(t, tx.filter("protein_ensembl_id IS NOT NULL"))
        _write_lines(
            [
                t.spark.createDataFrame([("##gff-version 3",)], "value string"),
                _gff(genes, "chromosome", "gene", "s", "e", "strand",
                     "concat('ID=gene:', gene_ensembl_id, ';Name=', gene_symbol, '%20x;gene_id=', gene_ensembl_id)"),
                _gff(tx, "chromosome", "mRNA", "tx_start + 1", "tx_end", "strand",
                     "concat('ID=transcript:', bare, ';Parent=gene:', gene_ensembl_id, ';biotype=', CASE WHEN tx_key % 12 = 0 THEN 'nonsense_mediated_decay' "
                     "ELSE 'protein_coding' END, ';tag=basic', CASE WHEN canonical >= 2 THEN ',Ensembl_canonical' ELSE '' END, ';transcript_id=', bare, ';version=1')"),
                _gff(exons, "chromosome", "exon", "genomic_start_tx + 1", "genomic_end_tx", "strand",
                     "concat('Parent=transcript:', bare, ';rank=', CAST(order_in_transcript AS STRING))"),
                _gff(segments, "chromosome", "CDS", "seg_start", "seg_end", "strand",
                     "concat('ID=CDS:', protein_ensembl_id, ';Parent=transcript:', bare, ';protein_id=', protein_ensembl_id)"),
            ],
            path,
        )

    return _once(t, "ensembl_gff", write)


def refseq_gff(t: Tables) -> str:
    def write(path: str) -> None:
        tx = _located(t).filter("transcript_refseq_id IS NOT NULL AND gene_geneid_id IS NOT NULL")
        genes = tx.groupBy("gene_geneid_id", "gene_symbol", "synonyms", "chromosome", "strand").agg(
            (F.min("tx_start") + 1).alias("s"), F.max("tx_end").alias("e")
        )
        exons = t.exons.select("tx_key", "order_in_transcript", "genomic_start_tx", "genomic_end_tx").join(tx, "tx_key")
        segments = _coding_segments(t, tx.filter("protein_refseq_id IS NOT NULL"))
        seqid = "concat('NC_', chromosome)"
        _write_lines(
            [
                t.spark.createDataFrame([("##gff-version 3",)], "value string"),
                _gff(t.genes.select("chromosome").distinct(), seqid, "region", "1", "1000000000", "'+'",
                     "concat('ID=r', chromosome, ';Name=', chromosome)"),
                _gff(genes, seqid, "gene", "s", "e", "strand",
                     "concat('ID=gene-', gene_symbol, ';Dbxref=GeneID:', gene_geneid_id, ';gene=', gene_symbol, ';gene_biotype=protein_coding', "
                     "CASE WHEN synonyms IS NULL THEN '' ELSE concat(';gene_synonym=', replace(synonyms, '; ', ',')) END)"),
                _gff(tx, seqid, "mRNA", "tx_start + 1", "tx_end", "strand",
                     "concat('ID=rna-', transcript_refseq_id, ';Dbxref=GeneID:', gene_geneid_id, CASE WHEN transcript_ensembl_id IS NULL THEN '' "
                     "ELSE concat(',Ensembl:', transcript_ensembl_id) END, ';gene=', gene_symbol, CASE WHEN canonical % 2 = 1 THEN ';tag=MANE Select' ELSE '' END, "
                     "';transcript_id=', transcript_refseq_id)"),
                _gff(exons, seqid, "exon", "genomic_start_tx + 1", "genomic_end_tx", "strand",
                     "concat('ID=exon-', transcript_refseq_id, '-', CAST(order_in_transcript AS STRING), ';Parent=rna-', transcript_refseq_id)"),
                _gff(segments, seqid, "CDS", "seg_start", "seg_end", "strand",
                     "concat('ID=cds-', protein_refseq_id, ';Parent=rna-', transcript_refseq_id, ';Name=', protein_refseq_id)"),
            ],
            path,
        )

    return _once(t, "refseq_gff", write)


def protein_flatfile(t: Tables) -> str:
    """Flat-file records with one Region per domain; the file's records end with ``//`` lines."""

    def write(path: str) -> None:
        region = F.concat(
            F.lit("     Region          "), F.col("aa_start").cast("string"), F.lit(".."), F.col("aa_end").cast("string"),
            F.lit('\n                     /region_name="'), F.coalesce("name", F.lit("unnamed")),
            F.lit('"\n                     /note="text of the\n                     domain; '), F.col("ext_id"), F.lit('"'),
            F.when(F.col("cdd").isNotNull(), F.concat(F.lit('\n                     /db_xref="CDD:'), "cdd", F.lit('"'))).otherwise(""),
        )
        regions = t.domains.select("tx_key", region.alias("r")).groupBy("tx_key").agg(F.array_join(F.array_sort(F.collect_list("r")), "\n").alias("regions"))
        p = t.proteins.filter("protein_refseq_id IS NOT NULL AND transcript_refseq_id IS NOT NULL").join(regions, "tx_key", "left")
        record = F.concat(
            F.lit("LOCUS       "), F.substring_index("protein_refseq_id", ".", 1), F.lit("  "), F.col("length").cast("string"), F.lit(" aa  linear\n"),
            F.lit("DEFINITION  "), F.coalesce("description", F.lit("none")), F.lit(".\nACCESSION   x\nVERSION     "), F.col("protein_refseq_id"),
            F.lit('\nFEATURES             Location/Qualifiers\n     source          1..9\n                     /organism="x"\n     Protein         1..9\n'),
            F.when(F.col("synonyms").isNotNull(), F.concat(F.lit('                     /note="'), "synonyms", F.lit('"\n'))).otherwise(""),
            F.when(F.col("regions").isNotNull(), F.concat("regions", F.lit("\n"))).otherwise(""),
            F.lit('     CDS             1..9\n                     /coded_by="'), F.col("transcript_refseq_id"), F.lit(':1..99"\nORIGIN\n        1 mmm\n//'),
        )
        p.select(record.alias("value")).write.mode("overwrite").text(path)

    return _once(t, "protein_flatfile", write)


def _tsv(df: DataFrame, path: str, header: bool) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "\u0000").option("emptyValue", "").csv(path)


def domain_tables(t: Tables) -> str:
    """The five domain tables of one species, the joined header for two of them and the split one for the rest."""

    def write(path: str) -> None:
        rows = t.domains.join(
            t.proteins.filter("protein_ensembl_id IS NOT NULL AND transcript_ensembl_id IS NOT NULL").select(
                "tx_key", "protein_ensembl_id", "transcript_ensembl_id"
            ),
            "tx_key",
        )
        shapes = {"pfam": (0, "Pfam", "PF"), "smart": (1, "SMART", "SM"), "cdd": (2, "CDD", "cd"), "tigrfams": (3, "TIGRFAM", "TIGR"), "interpro": (4, "Interpro", "IPR")}
        for source, (rest, label, prefix) in shapes.items():
            part = rows.filter(F.col("type_id") % 5 == rest)
            raw = F.concat(F.lit(prefix), F.regexp_replace("ext_id", r"^[A-Za-z]+", ""))
            if source in ("pfam", "interpro"):
                ids = [F.col("transcript_ensembl_id").alias("Transcript stable ID version"), F.col("protein_ensembl_id").alias("Protein stable ID version")]
            else:
                ids = [
                    F.substring_index("transcript_ensembl_id", ".", 1).alias("Transcript stable ID"),
                    F.split_part("transcript_ensembl_id", F.lit("."), F.lit(2)).alias("Version (transcript)"),
                    F.substring_index("protein_ensembl_id", ".", 1).alias("Protein stable ID"),
                    F.split_part("protein_ensembl_id", F.lit("."), F.lit(2)).alias("Version (protein)"),
                ]
            cols = [*ids, raw.alias(f"{label} ID"), F.col("aa_start").alias(f"{label} start"), F.col("aa_end").alias(f"{label} end")]
            if source == "interpro":
                cols += [F.coalesce("name", F.lit("short")).alias(f"{label} Short Description"), F.lit("long text").alias(f"{label} Description")]
            _tsv(part.select(*cols), f"{path}/H_sapiens.Domains.{source}.txt", header=True)

    return _once(t, "domain_tables", write)


def crosswalk_file(t: Tables) -> str:
    def write(path: str) -> None:
        specie = t.genes.select("gene_key", "specie")
        tax = F.expr("CASE specie WHEN 'H_sapiens' THEN 9606 WHEN 'M_musculus' THEN 10090 WHEN 'R_norvegicus' THEN 10116 WHEN 'D_rerio' THEN 7955 ELSE 8364 END")
        owner = t.transcripts.select(F.col("tx_key").alias("ord"), "gene_key").join(specie, "gene_key").select("ord", tax.alias("tax_id"))
        cols = ["gene_id", "ens_gene", "refseq_tx", "ens_tx", "refseq_prot", "ens_prot"]
        _tsv(t.crosswalk_raw.join(owner, "ord").select("tax_id", *cols), path, header=False)

    return _once(t, "crosswalk_file", write)


def orthology_files(t: Tables) -> str:
    """One file folder per species pair, named as the pair."""

    def write(path: str) -> None:
        names = t.genes.filter("gene_ensembl_id IS NOT NULL").select("gene_ensembl_id", "gene_symbol")
        rows = (
            t.ortholog_rows.join(names.toDF("a_id", "a_name"), "a_id").join(names.toDF("b_id", "b_name"), "b_id")
        )
        species = ["D_rerio", "H_sapiens", "M_musculus", "R_norvegicus", "X_tropicalis"]
        for i, a in enumerate(species):
            for b in species[i + 1 :]:
                part = rows.filter((F.col("a_species") == a) & (F.col("b_species") == b))
                _tsv(
                    part.select(
                        F.col("a_id").alias("Gene stable ID"), F.col("a_name").alias("Gene name"), F.col("b_id").alias("Other gene stable ID"),
                        F.col("b_name").alias("Other gene name"), F.lit("ortholog_one2one").alias("Other homology type"),
                    ),
                    f"{path}/{a}.{b}.orthology.txt",
                    header=True,
                )

    return _once(t, "orthology_files", write)


def match_xml(t: Tables) -> str:
    """InterPro match files: representative and other locations, with and without an ``ipr`` element."""

    def write(path: str) -> None:
        d = t.domains.filter("aa_end > 0")
        lcn = F.concat(
            F.lit('<lcn start="'), F.col("aa_start").cast("string"), F.lit('" end="'), F.col("aa_end").cast("string"), F.lit('"'),
            F.when(F.col("type_id") % 4 != 0, F.concat(F.lit(' score="'), (F.col("aa_end") - F.col("aa_start")).cast("string"), F.lit('.5"'))).otherwise(""),
            F.when(F.col("type_id") % 3 == 0, F.lit(' representative="true"/>')).otherwise(F.lit(' representative="false"/>')),
        )
        match = F.concat(
            F.lit('<match id="M'), "ext_id", F.lit('" name="member">'),
            F.when(F.col("type_id") % 2 == 0, F.concat(F.lit('<ipr id="'), "ext_id", F.lit('" name="entry"/>'))).otherwise(""),
            lcn, F.lit("</match>"),
        )
        proteins = d.groupBy("tx_key").agg(F.array_join(F.array_sort(F.collect_list(match)), "").alias("m"))
        proteins.select(
            F.concat(F.lit('<protein id="P'), F.col("tx_key").cast("string"), F.lit('">'), "m", F.lit("</protein>")).alias("value")
        ).write.mode("overwrite").text(path)

    return _once(t, "match_xml", write)


def genepred_file(t: Tables) -> str:
    def write(path: str) -> None:
        lists = t.exons.groupBy("tx_key").agg(F.array_sort(F.collect_list(F.struct("order_in_transcript", "genomic_start_tx", "genomic_end_tx"))).alias("x"))
        text = lambda f: F.concat(F.array_join(F.transform("x", lambda e: e[f].cast("string")), ","), F.lit(","))
        rows = _located(t).join(lists, "tx_key")
        _tsv(
            rows.select(
                F.concat(F.lit("uc"), F.col("tx_key").cast("string")).alias("name"), "chromosome", "strand", "tx_start", "tx_end",
                F.coalesce("cds_start", "tx_start").alias("cds_start"), F.coalesce("cds_end", "tx_end").alias("cds_end"), "exon_count",
                text("genomic_start_tx").alias("s"), text("genomic_end_tx").alias("e"),
            ),
            path,
            header=False,
        )

    return _once(t, "genepred_file", write)


def result_csv(t: Tables) -> str:
    """Documents as a quoted CSV: texts hold commas, quotes and line breaks."""

    def write(path: str) -> None:
        rows = t.source("documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("cluster"), "text")
        rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)

    return _once(t, "result_csv", write)


def header_files(t: Tables) -> str:
    """Every page as a saved file of its own, with its whole text."""

    def write(path: str) -> None:
        pages = t.source("pages").select("page_id", F.col("html").alias("value"))
        _files_of_their_own(pages, "page_id", path)

    return _once(t, "header_files", write)


def uniprot_idmap_file(t: Tables) -> str:
    """The headerless mapping file: 22 columns, of which three are filled."""

    def write(path: str) -> None:
        filled = {0: "accession", 3: "refseq_id", 19: "enst_id"}
        cells = [F.coalesce(filled[i], F.lit("")) if i in filled else F.lit(f"x{i}") for i in range(22)]
        t.mapping.select(F.concat_ws("\t", *cells).alias("value")).write.mode("overwrite").text(path)

    return _once(t, "uniprot_idmap", write)


def description_xml(t: Tables) -> str:
    """Entries with marked-up abstracts that run over several lines."""

    def write(path: str) -> None:
        record = """concat('<interpro id="', accession, '" type="', entry_type, '"><name>n</name>\n  <abstract><p>about <b>', accession,
            '</b>\n  &amp; its <cite idref="x"/> kin</p></abstract>\n</interpro>') AS value"""
        entries = t.entries.filter("accession IS NOT NULL AND entry_type IS NOT NULL").select("accession", "entry_type").distinct()
        entries.selectExpr(record).write.mode("overwrite").text(path)

    return _once(t, "description_xml", write)


def mapping_files(t: Tables) -> str:
    return _once(t, "mapping_files", lambda path: t.mapping.repartition(4).write.mode("overwrite").parquet(path))
